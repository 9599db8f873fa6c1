"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the spans of the base patterns (valid or not) and of wider ones for every kind (spelled-out
addresses, masked and long internet addresses, cards grouped by other marks, national telephone numbers).
Four labelers vote on each: validity (checksum, ranges, digits), a gazetteer (top-level domains, calling
codes, reserved networks, issuer digits), context words before the span, and the span's form. Votes are
-1, 0 or 1. Expectation-maximisation over the counts of vote patterns (counted over all documents)
estimates each labeler's reliability by kind. The posteriors are the soft labels of the final span
classifier, a logistic regression by kind on the votes and on the span itself: its shape, its length and
its neighbours on both sides. What comes to the driver are counts of (kind, votes, features), at most
``4 * 81 * 576`` rows. Base spans always stay; other candidates stay where the classifier is sure
(``SURE``), validity doesn't object and they touch no base span.

Positions are code points. Native functions don't give the places of matches; the lengths of the pieces
that ``split`` leaves and of the matches do. Patterns are possessive and begin at the end of the previous
match or at the border of a run, which gives the leftmost matches without quadratic scans of long runs.
Running sums over a text's matches go in runs of about the square root of their number, and texts are cut
from chunks, so that a text of nothing but addresses costs little more than its length.

Edge cases: null text is empty and has no spans; repeated rows are separate; an empty table gives no rows
(and a classifier that keeps base spans only); other columns are ignored or, in ``redacted``, kept.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
SURE = 0.95
ROUNDS = 40
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"

#: The contract's patterns, rewritten for linear time (same leftmost matches).
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9]*+(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?(?:\(at\)|\[at\])\x20?", r"(?:\x20?(?:\(dot\)|\[dot\])\x20?|\[\.\]|\(\.\))"
#: Wider forms: at and dot spelled out or in brackets, eight groups of hexadecimal digits, other marks between groups, national numbers.
WIDE = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++{_AT}[{_LABEL}]++(?:(?:{_DOT}|\.)[{_LABEL}]++)+",
    "ip": rf"(?<![0-9A-Za-z:.])(?:[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}|(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9._/])[0-9]{4}(?:(?:[._/]|\x20[-/]\x20)[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+)\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What a text must hold for a wide form; cheaper than looking for the form.
WIDE_HINT = {"email": r"[(\[]at[)\]]", "ip": r"[(\[](?:\.|dot)[)\]]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}(?:[._/]|\x20[-/]\x20)[0-9]{4}", "phone": r"[0-9]{3}[).-]"}

# Gazetteers (common top-level domains; calling codes of two digits and the beginnings of those of
# three; beginnings of issuer numbers; special networks) and context words.
DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "co", "ai", "app", "dev", "me", "tv", "cloud", "online", "shop", "site", "tech", "xyz",
    "ac", "ae", "ar", "at", "au", "be", "bg", "br", "ca", "ch", "cl", "cn", "cz", "de", "dk", "ee", "es", "eu", "fi", "fr", "gr", "hk", "hr", "hu", "ie", "il", "in", "is", "it",
    "jp", "kr", "lt", "lu", "lv", "mx", "my", "nl", "no", "nz", "pe", "pl", "pt", "ro", "rs", "ru", "se", "sg", "si", "sk", "th", "tr", "tw", "ua", "uk", "us", "uy", "ve", "vn", "za",
)
CALLING = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
CALLING_THREE = ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "87", "88", "96", "97", "99")
ISSUERS = r"^(?:4|5[0-8]|2[2-7]|3[0-9]|6)"
SPECIAL = r"^(?:0|127|255|22[4-9]|2[34][0-9])(?![0-9])"
PRIVATE = r"^(?:10|192.{1,7}168|169.{1,7}254|172.{1,7}(?:1[6-9]|2[0-9]|3[01]))(?![0-9])"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|to|von|an|correo)[\x20:]*$",
    "ip": r"(?i)(?:ip|host|server|address|from|client)[\x20:=]*$",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta|payment)[\x20:#]*$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|telefon|tél|móvil)[\x20.:]*$",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|token|serial|id|no\.|nr\.|v)[\x20:=#\"]*$"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the Luhn check."""
    d = F.reverse(_digits(s))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.substring(d, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(F.coalesce(x, F.lit(0))))
    return total % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    n = F.length(_digits(s))
    if kind == "ip":
        # longer parts than nine digits can't be cast, nor be at most 255 unless they begin with zeros
        return F.forall(F.split(s, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & F.forall(F.split(s, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return n.between(13, 19) & _luhn(s)
    return n.between(9, 15)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _numbers(n: Column) -> Column:
    """1 to n, none if n is 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))


def _running(values: Column, zero: int, op) -> Column:
    """Running results of ``op`` over an array of ints; appending within runs of the root of its size, so n^1.5 moves at most."""
    zero = F.lit(zero)

    def fold(x: Column, begin: Column) -> Column:
        grown = F.aggregate(x, F.array(begin), lambda acc, v: F.array_append(acc, op(F.element_at(acc, -1), v)))
        return F.slice(grown, 2, F.size(x))

    def of(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.size(v) - 1, width), lambda at: F.slice(v, at + 1, width))
        return _let(runs, lambda r: _let(F.concat(F.array(zero), fold(F.transform(r, lambda x: F.aggregate(x, zero, op)), zero)), lambda before: F.flatten(F.transform(r, lambda x, i: fold(x, F.element_at(before, i + 1))))))

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.expr("cast(array() as array<int>)")))


def _sums(values: Column) -> Column:
    return _running(values, 0, lambda a, x: a + x)


def _tops(values: Column) -> Column:
    return _running(values, 0, lambda a, x: F.greatest(a, x))


def _places(text: Column, patterns: list[tuple[str, Column]]) -> Column:
    """For each (pattern, whether the text may hold it) an array of all matches, in code points.

    A match is (start, end, value, up to 20 characters before, features); see ``_features``.
    """

    def of(x: Column) -> Column:
        found, gaps, numbers = x["found"], x["gaps"], _numbers(F.size(x["found"]))
        lengths = F.transform(numbers, lambda i: F.length(F.element_at(gaps, i)) + F.length(F.element_at(found, i)))

        def place(end: Column, i: Column) -> Column:
            value, gap, after = F.element_at(found, i + 1), F.element_at(gaps, i + 1), F.left(F.element_at(gaps, i + 2), F.lit(1))
            features = _features(value, F.right(gap, F.lit(1)), after).cast("int").alias("features")
            return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"), F.right(gap, F.lit(20)).alias("before"), features)

        return F.transform(_sums(lengths), place)

    none = F.expr("struct(cast(array() as array<string>) as found, cast(array() as array<string>) as gaps)")
    return F.transform(F.array(*(F.when(present, F.struct(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)).alias("found"), F.split(text, p, -1).alias("gaps"))).otherwise(none) for p, present in patterns)), of)


def _votes(kind: str, x: Column, valid: Column, base: bool) -> tuple[Column, Column, Column, Column]:
    value, one, zero, minus = x["value"], F.lit(1), F.lit(0), F.lit(-1)
    validity = F.when(valid, one).otherwise(minus) if base or kind in ("ip", "card") else zero
    context = F.when(F.regexp_like(x["before"], F.lit(CUES[kind])), one).when(F.regexp_like(x["before"], F.lit(AGAINST)), minus).otherwise(zero)
    digits = _digits(value)
    if kind == "email":
        top = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
        gazetteer = F.when(top.isin(*DOMAINS), one).when(F.regexp_like(top, F.lit("^[a-z]{2,}$")), zero).otherwise(minus)
        form = F.when(F.regexp_like(value, F.lit(r"^[.%+-]|\.\.")), minus).otherwise(one)
    elif kind == "ip":
        gazetteer = F.when(F.regexp_like(value, F.lit(SPECIAL)), minus).when(F.regexp_like(value, F.lit(PRIVATE)), zero).otherwise(one)
        form = F.when(F.regexp_like(value, F.lit(r"(?:^|\.)0[0-9]")), minus).otherwise(one)
    elif kind == "card":
        gazetteer = F.when(F.regexp_like(digits, F.lit(ISSUERS)), one).otherwise(minus)
        form = F.when(F.regexp_like(value, F.lit(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[^0-9]{1,3}[0-9]{4}){3})$")), one).otherwise(minus)
    else:
        two, first = F.substring(digits, 1, 2), F.substring(digits, 1, 1)
        gazetteer = F.when(two.isin(*CALLING, *CALLING_THREE) | first.isin("1", "7"), one).otherwise(minus if base else zero)
        form = F.when(F.regexp_like(value, F.lit(r"^\+?[0-9]{0,3}[\x20.-]?(?:\([0-9]{1,4}\))?[0-9\x20.-]+$")), one).otherwise(minus)
    return validity, gazetteer, context, form


#: Numbers of values of the span's features: shape, length, the character before, the character after.
SHAPES, LENGTHS, SIDES = 6, (8, 12, 16, 20, 30), 4


def _side(c: Column) -> Column:
    """0: none, 1: white space, 2: a letter or digit, 3: another character."""
    return F.when(F.coalesce(c, F.lit("")) == "", 0).when(F.regexp_like(c, F.lit(r"\s")), 1).when(F.regexp_like(c, F.lit(r"[\p{L}\p{N}]")), 2).otherwise(3)


def _features(value: Column, before: Column, after: Column) -> Column:
    """Code of the features: letters and number of marks in the span, its length, and what stands on both sides."""
    marks = F.length(F.regexp_replace(value, r"[\p{L}\p{N}]", ""))
    shape = F.when(F.regexp_like(value, F.lit(r"\p{L}")), 3).otherwise(0) + F.when(marks == 0, 0).when(marks <= 3, 1).otherwise(2)
    length = F.size(F.filter(F.array(*map(F.lit, LENGTHS)), lambda n: F.length(value) > n))
    return ((shape * (len(LENGTHS) + 1) + length) * SIDES + _side(before)) * SIDES + _side(after)


def feature_values(code: int) -> list[int]:
    """The places that are 1 in the one-hot features of a code."""
    out, at = [], [0, SHAPES, SHAPES + len(LENGTHS) + 1, SHAPES + len(LENGTHS) + 1 + SIDES]
    for base, n in zip(at[::-1], (SIDES, SIDES, len(LENGTHS) + 1, SHAPES)):
        out.append(base + code % n)
        code //= n
    return out[::-1]


N_FEATURES = SHAPES + len(LENGTHS) + 1 + 2 * SIDES


def _labelled(k: int, kind: str, base: bool):
    """A function from a place to the candidate with the codes of its votes and features."""

    def run(x: Column) -> Column:
        valid = _valid(kind, F.regexp_replace(x["value"], r"[^0-9]+", ".") if kind == "ip" else x["value"])
        if kind == "ip" and not base:
            valid = valid | F.contains(x["value"], F.lit(":"))
        code = sum((v + 1) * 3**i for i, v in enumerate(_votes(kind, x, valid, base)))
        return F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (valid if base else F.lit(False)).alias("base"), code.cast("int").alias("votes"), x["features"].alias("features"))

    return run


def candidates(docs: DataFrame, spans: str, *keep: str) -> DataFrame:
    """The columns ``keep`` and, as ``spans``, an array of (kind, start, end, base, votes, features) of each document.

    kind is the number in ``KINDS``; votes is the code of the four votes, in base 3.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digit = F.regexp_like(text, F.lit("[0-9]"))
    kinds, patterns = [], []
    for k, kind in enumerate(KINDS):
        present = F.contains(text, F.lit(HINT[kind])) if HINT[kind] else digit
        patterns += [(BASE[kind], present if kind == "email" else present & digit), (WIDE[kind], F.regexp_like(text, F.lit(WIDE_HINT[kind])))]
        kinds += [(k, kind, True), (k, kind, False)]

    def labelled(places: Column) -> Column:
        parts = []
        for i, (k, kind, base) in enumerate(kinds):
            own = F.element_at(places, i + 1)
            if kind == "card" and base:
                # shorter and longer numbers than any card has are no candidates
                own = F.filter(own, lambda x: F.length(_digits(x["value"])).between(13, 19))
            parts.append(F.transform(own, _labelled(k, kind, base)))
        return F.concat(*parts)

    return docs.select(*keep, _let(_places(text, patterns), labelled).alias(spans))


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def reliabilities(counts: dict[int, int], rounds: int = ROUNDS) -> tuple[float, dict[int, float]]:
    """Prior and posterior by vote pattern of one kind, by expectation-maximisation (naive Bayes, two classes)."""
    total = sum(counts.values())
    votes = {p: [p // 3**i % 3 for i in range(4)] for p in counts}
    # begin with the majority of votes
    posterior = {p: _sigmoid(1.5 * sum(v - 1 for v in votes[p])) for p in counts}
    prior = 0.5
    for _ in range(rounds):
        yes = sum(counts[p] * posterior[p] for p in counts)
        prior = (yes + 1) / (total + 2)
        rate = [[[0.5, 0.5, 0.5] for _ in range(4)] for _ in range(2)]
        for i in range(4):
            for p in counts:
                rate[1][i][votes[p][i]] += counts[p] * posterior[p]
                rate[0][i][votes[p][i]] += counts[p] * (1 - posterior[p])
            for c in (0, 1):
                s = sum(rate[c][i])
                rate[c][i] = [x / s for x in rate[c][i]]
        for p in counts:
            z = math.log(prior / (1 - prior)) + sum(math.log(rate[1][i][v] / rate[0][i][v]) for i, v in enumerate(votes[p]))
            posterior[p] = _sigmoid(z)
    return prior, posterior


def classifier(found: DataFrame, spans: str = "_spans") -> list[list[float]]:
    """Weights by kind: of the four votes, of the span's features, and a constant last.

    Logistic regression, fitted to the posteriors of all candidates. A kind without candidates has weight 0.
    """
    s = F.explode(spans).alias("s")
    rows = found.select(s).groupBy("s.kind", "s.votes", "s.features").count().collect()  # at most 4 * 81 * 576 rows
    out = []
    for k in range(len(KINDS)):
        own = sorted((r["votes"], r["features"], r["count"]) for r in rows if r["kind"] == k)
        weights = np.zeros(4 + N_FEATURES + 1)
        if own:
            votes: dict[int, int] = {}
            for p, _, n in own:
                votes[p] = votes.get(p, 0) + n
            _, posterior = reliabilities(votes)
            x = np.zeros((len(own), len(weights)))
            for row, (p, f, _) in zip(x, own):
                row[:4] = [p // 3**i % 3 - 1 for i in range(4)]
                row[[4 + j for j in feature_values(f)]] = 1
                row[-1] = 1
            y, share = np.array([posterior[p] for p, _, _ in own]), np.array([n for _, _, n in own]) / sum(votes.values())
            for _ in range(60):  # Newton's method with a small ridge
                q = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                gradient = x.T @ (share * (q - y)) + 1e-3 * weights
                hessian = (x * (share * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(weights))
                step = np.linalg.solve(hessian, gradient)
                weights -= np.clip(step, -2, 2)
                if np.abs(step).max() < 1e-6:
                    break
        out.append([round(float(w), 9) for w in weights])
    return out


def probability(weights: list[float], votes: int, features: int) -> float:
    z = sum(w * (votes // 3**i % 3 - 1) for i, w in enumerate(weights[:4])) + sum(weights[4 + j] for j in feature_values(features)) + weights[-1]
    return _sigmoid(z)


def _sure(x: Column, model: list[list[float]]) -> Column:
    """Whether the classifier is sure of a candidate and the validity labeler doesn't object."""
    def of(w: Column) -> Column:
        z = F.element_at(w, 4 + N_FEATURES + 1)
        for i in range(4):
            z = z + F.element_at(w, i + 1) * (F.floor(x["votes"] / 3**i) % 3 - 1)
        first, step = 4, SHAPES * (len(LENGTHS) + 1) * SIDES * SIDES
        for n in (SHAPES, len(LENGTHS) + 1, SIDES, SIDES):
            step //= n
            z = z + F.element_at(w, (F.floor(x["features"] / step) % n + first + 1).cast("int"))
            first += n
        return z

    z = _let(F.element_at(F.array(*(F.lit(w) for w in model)), x["kind"] + 1), of)
    return (z >= math.log(SURE / (1 - SURE))) & (x["votes"] % 3 != 0)


def decided(found: DataFrame, model: list[list[float]], spans: str = "_spans") -> DataFrame:
    """``spans`` with what stays, (kind, start, end, base): base spans, and sure candidates that touch none; by kind, then start."""
    short = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"))
    chosen = F.transform(F.filter(spans, lambda x: x["base"] | _sure(x, model)), short)

    def apart(s: Column) -> Column:
        """Of spans in order: the base ones, and those that end before any base span that follows and begin after all before."""
        far = F.lit(2**31 - 1)
        ends = _tops(F.transform(s, lambda x: F.when(x["base"], x["end"]).otherwise(0)))
        # least start of the base spans from here on: the running maximum, from the end, of its distance from far
        starts = F.reverse(_tops(F.transform(F.reverse(s), lambda x: F.when(x["base"], far - x["start"]).otherwise(0))))
        return _let(F.struct(ends.alias("e"), starts.alias("s")), lambda b: F.filter(s, lambda x, i: x["base"] | (F.element_at(b["e"], i + 1) <= x["start"]) & (far - F.element_at(b["s"], i + 1) >= x["end"])))

    kept = _let(F.array_sort(chosen), lambda s: F.when(F.exists(s, lambda x: ~x["base"]), apart(s)).otherwise(s))
    return found.withColumn(spans, F.array_sort(F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, keep_table=None) -> DataFrame:
    """doc_id and ``_spans`` of each document. keep_table: writes a table and reads it again (scanned twice)."""
    found = candidates(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "_spans", "doc_id")
    if keep_table:
        found = keep_table(found)
    return decided(found, classifier(found))


def digest(spans: DataFrame) -> DataFrame:
    """Counts and hash of base spans, all spans as text and their number."""
    base = F.filter("_spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"), F.size("_spans").cast("long").alias("n_spans"))


CHUNK = 4096


def _cut(chunks: Column, start: Column, n: Column) -> Column:
    """``n`` characters of a text from ``start`` on, from its chunks."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((start + n - 1) / CHUNK).cast("int")
    return F.when(n > 0, F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start % CHUNK + 1, n)).otherwise("")


def redacted(docs: DataFrame, keep_table=None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap go as one.

    keep_table: as in ``find``; without it candidates are found twice. Columns keep their names, whatever they are.
    """
    columns = docs.columns
    spans, clean = common.free(columns, "spans", "text")
    found = candidates(docs, spans, *(F.col(f"`{c}`") for c in columns))
    if keep_table:
        found = keep_table(found)
    rows = decided(found, classifier(found, spans), spans)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    name = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def pieces(x: Column) -> Column:
        s, chunks = x["s"], x["chunks"]

        def joined(tops: Column) -> Column:
            """``tops``: the furthest end so far, before the first span 0."""

            def piece(y: Column, i: Column) -> Column:
                begin = F.element_at(tops, i + 1)
                return F.when(y["start"] >= begin, F.concat(_cut(chunks, begin, y["start"] - begin), F.element_at(name, y["kind"] + 1))).otherwise("")

            end = F.element_at(tops, -1)
            return F.concat(F.array_join(F.transform(s, piece), ""), _cut(chunks, end, x["n"] - end))

        return _let(F.concat(F.array(F.lit(0)), _tops(F.transform(s, lambda y: y["end"]))), joined)

    whole = F.struct(ordered.alias("s"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"), F.length(text).alias("n"))
    some = F.size(spans) > 0
    rows = rows.withColumn(clean, F.when(some, _let(whole, pieces)).otherwise(F.col("text").cast("string")))
    out = {"text": F.col(clean).cast(docs.schema["text"].dataType).alias("text")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(some, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return rows.select(*(out.get(c, F.col(f"`{c}`")) for c in columns))
