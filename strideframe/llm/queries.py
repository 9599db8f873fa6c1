"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, language_id, lm_scoring, mixing, mpeg_audio, neighbours, ngram_join, packing, periodic_runs, phrases, pii, sharding, suffix_dedup, token_files


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(common.documents(spark, sf_dir)).drop("text_key")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(common.documents(spark, sf_dir))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_shards(common.documents(spark, sf_dir)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.documents(spark, sf_dir)).drop("source")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.crc_bucket("doc_id", 3) == 1
    contents = language_id.dictionaries(docs.where(~held_out))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    return language_id.predicted(rows, contents, "doc_id", "held_out", "text").select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(common.documents(spark, sf_dir), lambda df: common.written(df, "pii")))


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = common.written(mpeg_audio.with_media(common.documents(spark, sf_dir)), "media")
    return mpeg_audio.properties(stored)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", (common.crc_bucket("doc_id", 10) == 0).alias("held_out"))
    return lm_scoring.score(docs)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(common.documents(spark, sf_dir)))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.ranked(phrases.mine(common.documents(spark, sf_dir)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(periodic_runs.planted(common.documents(spark, sf_dir))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_sharding": op2_sharding,
    "op3_neighbours": op3_neighbours,
    "op4_packing": op4_packing,
    "op5_token_files": op5_token_files,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_mpeg_audio": op9_mpeg_audio,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_phrases": op12_phrases,
    "op13_periodic_runs": op13_periodic_runs,
}

#: Brute force: all pairs of distinct sets that share a shingle, and the closure of their links.
OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i+4], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS u(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM rare JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
duo AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, duo.b FROM reach JOIN duo ON duo.a = reach.r)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.r) AS component_id
FROM documents d JOIN reach ON reach.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP12_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i+k-1], ' ') AS phrase FROM w, (VALUES (1), (2), (3)) AS s(k), unnest(range(1, len(ws) - k + 2)) AS u(i)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING k = 1 OR count(*) >= 10),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(string_split(phrase, ' ')[:c], ' ') AS first, array_to_string(string_split(phrase, ' ')[c+1:], ' ') AS rest
  FROM f, unnest(range(1, k)) AS u(c) WHERE k > 1),
s AS (
  SELECT cuts.*, x.a AS l, y.a AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i+1], ' ') AS phrase, max(a) AS longer FROM best, (VALUES (1), (2)) AS u(i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside i ON i.lang = best.lang AND i.phrase = best.phrase WHERE coalesce(100 * longer < 50 * a, true)),
ranked AS (SELECT kept.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {"op1_ngram_join": OP1_SQL, "op12_phrases": OP12_SQL}
