"""Substring join without a nested loop (JOIN02): texts that contain a fragment, by the rarest piece of each fragment.

A fragment's pieces of ``q`` characters (a shorter one is its own piece) are looked up among the texts' pieces. Counts of the
pieces that some fragment has say which one of a fragment is the rarest; texts and fragments meet by that piece alone, and the
pairs are then verified. Equal fragments are looked for once; what was found is told to their rows at the end, by as many
tasks as the number of pairs asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialised
from .asof import dealt

#: Pieces of fragments that go to all workers, some bytes each; more are joined by an exchange.
PIECES = 1_000_000
#: Texts that one task looks through, and pairs that one task tells.
TEXTS, PAIRS = 100_000, 20_000_000


def _pieces(text: Column, length: Column) -> Column:
    """Distinct pieces of ``length`` characters; the empty piece for length 0."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - length + 1), lambda i: F.substring(text, i, length))
    return F.when(length == 0, F.array(F.lit(""))).when(F.length(text) >= length, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, text: str, fragments: DataFrame, fragment: str, q: int = 3, pairs: int = PAIRS) -> DataFrame:
    """All pairs of a row of ``texts`` and a row of ``fragments`` whose text contains the fragment; nulls match nothing, an
    empty fragment matches every text. Columns of the two sides must differ in name. pairs: what one task should tell.
    """
    wanted = fragments.where(F.col(fragment).isNotNull())
    size = F.least(F.length(fragment), F.lit(q))
    asked = wanted.select(F.col(fragment).alias("_f"), F.explode(_pieces(F.col(fragment), size)).alias("_piece")).distinct()
    pieces = asked.select("_piece").distinct()
    few = pieces.count() <= PIECES
    sizes = [r[0] for r in wanted.select(size).distinct().collect()]  # q + 1 numbers at most
    own = F.flatten(F.array(*(_pieces(F.col(text), F.lit(n)) for n in sizes))) if sizes else F.array().cast("array<string>")
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    count = texts.count()
    looked = texts.repartition(-(-count // TEXTS)) if count > TEXTS else texts  # short rows of a small file would be one task
    held = looked.select(F.explode(own).alias("_piece")).join(small(pieces), "_piece").groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    by_count = Window.partitionBy("_f").orderBy(F.coalesce("_n", F.lit(0)), "_piece")
    rarest = asked.join(held, "_piece", "left").withColumn("_r", F.row_number().over(by_count)).where("_r = 1 and _n > 0").select("_f", "_piece")
    found = looked.withColumn("_piece", F.explode(own)).join(small(rarest), "_piece").where(F.contains(F.col(text), F.col("_f"))).drop("_piece")
    return _told(materialised(found), wanted, fragment, pairs).select(*texts.columns, *fragments.columns)


def _told(found: DataFrame, wanted: DataFrame, fragment: str, pairs: int) -> DataFrame:
    """``found`` (texts with a fragment ``_f``) met with the rows that have this fragment, about ``pairs`` a task."""
    n = lambda df, by, name: df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    product = F.col("_a").cast("decimal(38,0)") * F.col("_b")
    total, rows = n(found, "_f", "_a").join(n(wanted.withColumnRenamed(fragment, "_f"), "_f", "_b"), "_f").agg(F.sum(product), F.sum("_b")).first()
    tasks = max(1, min(-(-int(total or 0) // pairs), 100_000))
    if (rows or 0) <= PIECES:
        spread = found.repartition(tasks) if tasks > 1 else found
        return spread.join(F.broadcast(wanted), F.col("_f") == F.col(fragment))
    one, two = dealt(found, wanted.withColumn("_f", F.col(fragment)), ["_f"], max(1, int(pairs**0.5)))
    on = ["_f", "_l", "_r"]
    return one.repartition(tasks, *on).join(two.repartition(tasks, *on), on)
