"""Small tables for the corpus operators' tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def documents(spark, texts, first=0, lang="en", sources=("a", "b", "c")):
    rows = [(first + i, t, lang, sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: null, empty, blanks only, one word, marks only, umlauts and wide characters, other white space, a repeated text
ODD = [None, "", "  \t\n", "word", "!!! 123 ...", "Grüße an Ærø 漢字 ﬁ é", "a b c\x1cd", "same text here for two rows", "same text here for two rows"]


def extra(df):
    """With columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    for c in ("size", "shard", "slot", "rank", "_size", "_bucket", "target", "component_id", "spans", "score", "leaf"):
        df = df.withColumn(c, F.lit("other"))
    return df
