"""Running values along a sequence of a key without putting the key's rows into one task.

Positions are cut into buckets; a window runs inside each, and only one row per bucket is windowed per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

__all__ = ["running", "carried", "BUCKET"]

BUCKET = 16_384


def running(df: DataFrame, key: str, order: str, value: Column, out: str, kind: str = "sum", before: bool = False, bucket: int = BUCKET) -> DataFrame:
    """Adds *out*, the sum (or max) of *value* over the rows of *key* up to this one in *order* (*before*: without it).

    *order* is a whole number, unique within the key. Null values count as nothing; a sum over nothing is 0, a max
    null. All columns stay, whatever their names; *out* is added, or replaces a column of its name.
    """
    f = F.sum if kind == "sum" else F.max
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    d = df.select(F.struct(*kept).alias("row"), F.col(f"`{key}`").alias("k"), F.col(f"`{order}`").alias("o"), value.alias("v"))
    d = d.withColumn("b", F.floor(F.col("o") / bucket)).repartition("k", "b")
    w = W.partitionBy("k", "b").orderBy("o").rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    d = d.withColumn("c", f("v").over(w))
    earlier = f("t").over(W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
    totals = d.groupBy("k", "b").agg(f("v").alias("t")).select(F.col("k").alias("tk"), F.col("b").alias("tb"), earlier.alias("t"))
    d = d.join(totals, F.col("k").eqNullSafe(F.col("tk")) & F.col("b").eqNullSafe(F.col("tb")), "left")
    got = F.coalesce("c", F.lit(0)) + F.coalesce("t", F.lit(0)) if kind == "sum" else F.greatest("c", "t")
    return d.select("row.*", got.alias(out))


def carried(d: DataFrame, key: str, bucket: str, order: str, value: Column, out: str, before: bool = False) -> DataFrame:
    """Adds *out*, the running max of *value*, to a lean table that is already partitioned by *key* and *bucket*.

    A window runs inside each bucket; what earlier buckets had comes from a table of one row per bucket. As *d* should be
    written already (its lineage cut), reading it for that table costs no more than its rows, and neither side of the join
    moves them: only the rows of buckets are shuffled.
    """
    w = W.partitionBy(key, bucket).orderBy(order).rowsBetween(W.unboundedPreceding, -1 if before else W.currentRow)
    earlier = F.max("__v").over(W.partitionBy(key).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    totals = d.groupBy(key, bucket).agg(F.max(value).alias("__v")).select(F.col(key).alias("__k"), F.col(bucket).alias("__b"), earlier.alias("__e"))
    d = d.withColumn("__here", F.max(value).over(w))
    d = d.join(totals, F.col(key).eqNullSafe(F.col("__k")) & F.col(bucket).eqNullSafe(F.col("__b")), "left")
    return d.withColumn(out, F.greatest("__here", "__e")).drop("__here", "__k", "__b", "__e")
