"""Mixing sources to target weights over fixed-length blocks of words.

Each source's words, documents end to end, are cut into blocks of ``block`` words (the last one may be
shorter). Output shards draw their counts one after the other, each a multinomial draw with what the
sources' targets still lack as weights. Totals aren't forced: what one shard draws too much of, later
ones draw less of, so a source ends within some blocks of its target. A source's slots, counted over all
shards, go through a pseudorandom permutation of its block numbers, a new one for each pass over the
source: every block is used equally often, give or take one, and slots beyond ``most`` passes aren't
drawn. Slots and documents meet in a join by (source, block); every use keeps its shard and slot.

One row for each source comes to the driver, where targets and draws are made: sources are the mixture's
settings, and their number is taken to fit there.

Edge cases: null text has size 0 and is taken 0 times; null source is a source of its own, last; a
source without words has target 0; repeated rows are separate documents; an empty table gives no rows;
other columns are ignored (``mixed_documents`` keeps them,
whatever their names). Runs agree: all draws come from ``seed`` and ``draw_seed``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 64
MOST = 3
FEW_SOURCES = 50_000
WEIGHTS = (5.0, 2.0, 1.0)
RUN = 4096  # slots that one row stands for before they are listed


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Targets by weight that share all words, none above ``most`` times its source; excess is reshared."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * each >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * each
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def draws(wanted: list[int], limits: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each output shard (rows), near ``wanted`` in all and never above ``limits``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left, room = np.array(wanted, np.int64), np.array(limits, np.int64)
    out = np.zeros((shards, len(wanted)), np.int64)
    for t in range(shards):
        lacking = np.minimum(np.maximum(left, 0), room)
        n = -(-int(lacking.sum()) // (shards - t))
        if n:
            out[t] = np.minimum(rng.multinomial(n, lacking / lacking.sum()), room)
            left -= out[t]
            room -= out[t]
    return out


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``x``: a Feistel network, walked until it falls below n."""
    if n <= 1:
        return np.zeros_like(x)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = common.mix64(np.arange(4, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    out, open_ = x.astype(np.uint64), np.arange(len(x))
    while len(open_):
        left, right = out[open_] >> np.uint64(half), out[open_] & mask
        for k in keys:
            left, right = right, left ^ (common.mix64(right ^ k) & mask)
        out[open_] = (left << np.uint64(half)) | right
        open_ = open_[out[open_] >= n]
    return out.astype(np.int64)


def sized(docs: DataFrame, name: str = "_size") -> DataFrame:
    return docs.withColumn(name, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD)).cast("long"))


def plan(spark, totals: list[tuple[str | None, int]], block: int, most: int, shards: int, seed: int) -> tuple[list[dict], DataFrame]:
    """For each source its size, target and blocks; and the table of cells (shard, source, first slot, count)."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in order]
    wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(order))], most)
    blocks = [-(-n // block) for n in sizes]
    slots = [min(most * b, round(t * b / n)) if n else 0 for b, n, t in zip(blocks, sizes, wanted)]
    drawn = draws(slots, [most * b for b in blocks], shards, seed)
    first = np.cumsum(drawn, axis=0) - drawn
    sources = [{"source": s, "source_no": i, "source_size": n, "target": t, "blocks": b} for i, ((s, n), t, b) in enumerate(zip(order, wanted, blocks))]
    t, i = np.nonzero(drawn)
    cells = pa.table({"shard": pa.array(t, pa.int32()), "source_no": pa.array(i, pa.int32()), "first": first[t, i], "n": drawn[t, i], "blocks": np.array(blocks, np.int64)[i]})
    return sources, spark.createDataFrame(cells) if len(t) else spark.createDataFrame([], "shard int, source_no int, first long, n long, blocks long")


def slot_blocks(cells: DataFrame, seed: int) -> DataFrame:
    """shard, source_no, slot and the block that the slot maps to."""
    run = F.expr(f"explode(sequence(0L, (n - 1) div {RUN}))")
    runs = cells.withColumn("_run", run).select("shard", "source_no", "blocks", (F.col("first") + F.col("_run") * RUN).alias("_from"), F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("_run") * RUN).alias("_n"))
    slots = runs.repartition(common.width(cells.sparkSession), "shard", "source_no", "_from").withColumn("slot", F.explode(F.expr("sequence(_from, _from + _n - 1)")))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("shard", "source_no", "slot", "blocks")}
            turn, at = cols["slot"] // cols["blocks"], cols["slot"] % cols["blocks"]
            out = np.zeros(len(at), np.int64)
            kinds = cols["source_no"].astype(np.int64) * (1 << 20) + turn
            for kind in np.unique(kinds):
                here = kinds == kind
                out[here] = permuted(at[here], int(cols["blocks"][here][0]), seed * 1_000_003 + int(kind))
            yield pa.RecordBatch.from_arrays([pa.array(cols["shard"]), pa.array(cols["source_no"]), pa.array(cols["slot"]), pa.array(out)], names=["shard", "source_no", "slot", "block"])

    return slots.select("shard", "source_no", "slot", "blocks").mapInArrow(mapped, "shard int, source_no int, slot long, block long")


def positions(rows: DataFrame, sources: list[dict]) -> DataFrame:
    """``source_no`` and ``_at``, the place of each document's first word among its source's words.

    A source may hold a third of all rows: it's summed in hash buckets, in order within each.
    """
    spark = rows.sparkSession
    numbers = spark.createDataFrame([(s["source"], s["source_no"], s["source_size"], s["target"]) for s in sources], "_source string, source_no int, source_size long, target double")
    # one row for each source: sent to all workers while they are few, else joined like any table
    numbers = F.broadcast(numbers) if len(sources) <= FEW_SOURCES else numbers.hint("merge")
    keyed = rows.join(numbers, F.col("source").cast("string").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_size"), F.lit(common.width(spark))))
    sums = keyed.groupBy("source_no", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = sums.select("source_no", "_bucket", (F.sum("_sum").over(Window.partitionBy("source_no").orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    w = Window.partitionBy("source_no", "_bucket").orderBy("doc_id", "_size")
    placed = keyed.withColumn("_row", F.row_number().over(w)).withColumn("_within", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    return placed.join(before, ["source_no", "_bucket"]).withColumn("_at", F.col("_before") + F.col("_within")).drop("_before", "_within")


def mix(docs: DataFrame, block: int = BLOCK, most: int = MOST, shards: int = 64, seed: int = 11, draw_seed: int | None = None, keep_uses: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_shard and last_shard of each document.

    first_shard, last_shard: the output shards, of 0 to ``shards`` - 1, that words of it go to first and
    last; null where none go. keep_uses: also ``uses``, an array of (first word, words, times, slots) of the
    document's blocks, slots an array of (shard, slot). draw_seed: for the multinomial draws alone.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark, 10_000)
    narrow = common.written(sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))).drop("text"), "mixing")
    totals = [(r["source"], common.scalar(r["n"])) for r in narrow.groupBy("source").agg(F.sum("_size").alias("n")).collect()]  # one row for each source
    sources, cells = plan(spark, totals, block, most, shards, seed if draw_seed is None else draw_seed)
    uses = slot_blocks(cells, seed).groupBy("source_no", "block").agg(F.array_sort(F.collect_list(F.struct("shard", "slot"))).alias("_slots"))  # at most ``most``
    placed = positions(narrow, sources)
    last = F.floor((F.col("_at") + F.col("_size") - 1) / block)
    parts = placed.withColumn("block", F.explode_outer(F.when(F.col("_size") > 0, F.sequence(F.floor(F.col("_at") / block), last))))
    begin, end = F.greatest(F.col("_at"), F.col("block") * block), F.least(F.col("_at") + F.col("_size"), (F.col("block") + 1) * block)
    parts = parts.withColumn("_first", begin - F.col("_at")).withColumn("_words", end - begin)
    # the planner can't see that slots multiply the few cells; without the hint it would broadcast their counts
    met = parts.join(uses.hint("merge"), ["source_no", "block"], "left").withColumn("_times", F.coalesce(F.array_size("_slots"), F.lit(0)))
    key = ["source_no", "_bucket", "_row", "doc_id", "source", "_size", "source_size", "target"]
    sums = [F.coalesce(F.sum(F.col("_words") * F.col("_times")), F.lit(0)).cast("long").alias("taken"), F.min(F.array_min("_slots")["shard"]).alias("first_shard"), F.max(F.array_max("_slots")["shard"]).alias("last_shard")]
    if keep_uses:
        sums.append(F.array_sort(F.collect_list(F.when(F.col("_words") > 0, F.struct("_first", "_words", "_times", F.col("_slots").alias("slots"))))).alias("uses"))
    out = met.groupBy(*key).agg(*sums)
    return out.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "taken", "first_shard", "last_shard", *(["uses"] if keep_uses else []))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: pass k holds the words in blocks used at least k times.

    A document used whole keeps its text byte for byte; of one used in part, the runs of its used words
    remain as they stand in it. One never used goes. ``n_chars``, where there is one, follows the text.
    Rows of equal (doc_id, source, size) share their uses: the first of them stands for all.
    """
    size, nth, turn, used, every, kept = common.free(docs.columns, "size", "nth", "turn", "used", "all", "uses")
    uses = mix(docs, keep_uses=True, **options).where("taken > 0").select("doc_id", "source", F.col("size").alias("_size"), F.transform("uses", lambda x: F.struct(x["_first"].alias("_first"), x["_words"].alias("_words"), x["_times"].alias("_times"))).alias(kept))
    uses = uses.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "source", "_size").orderBy(kept)))
    rows = sized(docs, size).withColumn(nth, F.row_number().over(Window.partitionBy(F.col("doc_id"), F.col("source"), F.col(size)).orderBy("text")))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("u.doc_id")) & F.col("d.source").cast("string").eqNullSafe(F.col("u.source")) & (F.col(f"d.{size}") == F.col("u._size")) & (F.col(f"d.{nth}") == F.col("u._nth"))
    joined = rows.alias("d").join(uses.alias("u"), same).select("d.*", F.col(f"u.{kept}"))
    turns = joined.withColumn(turn, F.explode(F.expr(f"sequence(1, array_max(transform({kept}, x -> x._times)))")))
    turns = turns.withColumn(used, F.filter(kept, lambda x: x["_times"] >= F.col(turn)))
    whole = F.size(used) == F.size(kept)
    words = F.regexp_extract_all("text", F.lit(f"({common.WORD})"), F.lit(1))
    some = F.array_join(F.flatten(F.transform(used, lambda x: F.slice(F.col(every), (x["_first"] + 1).cast("int"), x["_words"].cast("int")))), " ")
    turns = turns.withColumn(every, F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        turns = turns.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return turns.select(*(F.col(f"`{c}`") for c in docs.columns))
