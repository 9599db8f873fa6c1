from pyspark.sql import functions as F

import corpus_pipeline
from strideframe.llm import common, packing
from strideframe.llm.queries import ORACLE, QUERIES

from .helpers import ODD, documents, empty, extra, words


def test_registered():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == sorted(range(1, 14), key=lambda n: list(QUERIES).index(next(k for k in QUERIES if k.startswith(f"op{n}_"))))
    assert len(QUERIES) == 13 and set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "source_mix", "packing"]


def test_stages_one_by_one(spark):
    texts = [words(60 + i, i) for i in range(40)] + [words(60, 0) + " end", words(61, 1)] + ["mail me at x@y.example.com " + words(30, 99)] + ODD
    docs = documents(spark, texts)
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, seen, ""), name)
        assert out.columns == docs.columns
        if name == "language_id":
            assert {r.doc_id for r in out.collect()} >= set(range(43))
        if name == "near_duplicates":
            assert not {40, 41} & {r.doc_id for r in out.collect()} and {0, 1} <= {r.doc_id for r in out.collect()}
        if name == "personal_data":
            assert out.where("text like '%[EMAIL]%'").count() == 1 and out.where("text like '%@%'").count() == 0
        seen = out
    last = corpus_pipeline.STAGES[-1][1](spark, seen, "")
    assert last.agg({"length": "sum"}).first()[0] == packing.pieces(seen).agg({"length": "sum"}).first()[0]


def test_stages_keep_columns_of_any_name(spark):
    """Names with dots and names that the operators use themselves, in every stage."""
    docs = documents(spark, [words(60 + i, i) for i in range(12)] + [words(61, 1)] + ODD)
    docs = extra(docs).withColumn("meta.url", F.concat(F.lit("u"), "doc_id")).withColumn("c0", F.lit(0)).withColumn("found_lang", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, docs, ""), name)
        assert out.columns == docs.columns and out.count() > 9
        assert out.where(F.col("`meta.url`") != F.concat(F.lit("u"), "doc_id")).count() == 0 and out.where("leaf <> 'other' or c0 <> 0 or found_lang <> 'x'").count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 9


def test_no_rows(spark):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_whole_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and max(r.offset + r.length for r in rows) <= 4096
