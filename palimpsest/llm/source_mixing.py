"""Operator 7, mixing sources to target weights; DataFrame functions only.

Targets: every source's share of the total by weight, never above `most` times its own size; what a capped source leaves is
shared again by weight (water filling, in closed form over one row a source). Documents: a hash-random key orders each
source; the key's range is cut into ranges of about `per_range` documents, so that no source is one task; prefix sums run
inside a range and, over one row a range, across them. A source is taken whole as often as its target holds it (epochs),
then by key up to the exact rest of its budget.

Null text has size 0. A null source is a source of its own, the last. Keys come from id and text, so rows without id, or
under one id, fall into all ranges. Rows that are alike in id, text and source share a range and are
interchangeable: a cut between them takes the same words whichever comes first. An empty table, or sources of size 0, take 0
words. Other columns stay; a column named like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
PER_RANGE = 10_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(id_col: str, text: str) -> Column:
    """The hash-random key of a row, from its id and its text, so that rows without id or under one id are spread too."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, weight, target from one row a source (source, source_size, n_docs)."""
    by_code_point = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_code_point) - 1) % len(weights) + 1).cast("int")).cast("double")
    everything = Window.partitionBy()
    cap = most * F.col("source_size")
    # Sources fill up in the order of cap / weight. With the first k capped, each other gets level * weight.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    out = sizes.withColumn("weight", weight).withColumn("cap", cap.cast("double")).withColumn("total", share * F.sum("source_size").over(everything))
    out = out.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # The first source that its level doesn't fill sets the level of all that follow it.
    first_free = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("target", F.least(F.col("cap"), F.coalesce(first_free * F.col("weight"), F.col("cap")))).select("source", "source_size", "n_docs", "weight", "target")


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, per_range: int = PER_RANGE, whole: bool = False, size: str | None = None, key: str | None = None) -> DataFrame:
    """df with size, source_size, target and taken (words, repeats counted). size, key: columns that have the sizes
    and the order keys already, for a table without texts.

    whole: take the document at the cut whole if that comes nearer to the budget, else not at all, and add `copies`.
    """
    sized = df.withColumn("size", F.col(size).cast("long") if size else n_words(text)).withColumn("__source", F.col(source)).withColumn("__key", F.col(key) if key else order_key(id_col, text))
    per_source = sized.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goals = targets(per_source, weights, share, most).withColumn("__ranges", F.ceil(F.col("n_docs") / per_range))
    goals = goals.select(F.col("source").alias("__goal"), "source_size", "target", "__ranges")
    known = [c for c in ("source_size", "target", "taken", "copies") if c in df.columns]
    # One row a source; where there are many, Spark joins by shuffle instead.
    rows = sized.drop(*known).join(goals, F.col("__source").eqNullSafe(F.col("__goal"))).drop("__goal")
    place = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__range", F.floor(place * F.col("__ranges") / F.lit(2**32)))
    inside = Window.partitionBy("__source", "__range").orderBy("__key", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("__source").alias("__s"), F.col("__range").alias("__r")).agg(F.sum("size").alias("__sum"))
    across = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__s", "__r", F.coalesce(F.sum("__sum").over(across), F.lit(0)).alias("__base"))
    rows = rows.join(sums, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r"))).drop("__s", "__r")
    start = F.col("__base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("__epochs", epochs).withColumn("__left", budget - F.col("__epochs") * F.col("source_size") - start)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left"))).cast("long")
    out = rows
    if whole:
        more = ((F.col("size") > 0) & (2 * F.col("__left") > F.col("size"))).cast("long")
        out = out.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.col("__epochs") + more).cast("long"))
        part = more * F.col("size")
    out = out.withColumn("taken", F.col("__epochs") * F.col("size") + part)
    return out.drop("__source", "__key", "__ranges", "__range", "__base", "__epochs", "__left")
