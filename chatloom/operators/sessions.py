"""Sessions of activity, split at inactivity gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

__all__ = ["sessionize", "is_blank"]

GAP_US = 30 * 60 * 1_000_000
SLICE_US = 6 * 3_600 * 1_000_000


def is_blank(text: Column) -> Column:
    """Null, empty or only white space, control and format characters."""
    return text.isNull() | ~text.rlike(r"[^\p{Z}\p{C}\s]")


def _islands(df: DataFrame, by: list[Column], gap_us: int) -> DataFrame:
    """Adds ``__n``: lag of the end flags gaps, the running sum of flags numbers the islands."""
    w = W.partitionBy(*by).orderBy("__start", "__end")
    before = F.max("__end").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = F.when(before.isNull() | (F.col("__start") - before > gap_us), 1).otherwise(0)
    return df.withColumn("__cut", cut).withColumn("__n", F.sum("__cut").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def sessionize(df: DataFrame, keys: list[str], ts: str, gap_us: int = GAP_US, slice_us: int = SLICE_US, event: str | None = None) -> DataFrame:
    """``keys…, start_us, end_us, duration_us, n_events``: one row per session.

    A session is a longest sequence of a key's events with no gap above *gap_us* between neighbours in time.

    Per slice of time (*slice_us*) of a key, events are numbered by lag and running sum and aggregated, so no task
    ever sorts more than a key's events of one slice. A session inside a slice is final; only the first and the last
    of each slice can go on in a neighbouring one, and just these (two rows per key and slice at most, whatever
    the number of events) are sorted per key and joined, again by lag and running sum. Events of equal key and time
    are counted before the first sort. *event* names a column that copies of one event share: they count once.

    Defined cases: rows with a null key or time are left out; an event alone is a session of duration 0; equal times
    are one point with several events; a gap of exactly *gap_us* does not split. Other columns are ignored.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    d = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.unix_micros(F.col(f"`{ts}`")).alias("__start"))
    if event:
        d = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.unix_micros(F.col(f"`{ts}`")).alias("__start"), F.col(f"`{event}`").alias("__id")).distinct()
    d = d.dropna(subset=[*names, "__start"])
    d = d.groupBy(*names, "__start").agg(F.count(F.lit(1)).alias("__events"))
    d = d.withColumn("__end", F.col("__start")).withColumn("__slice", F.floor(F.col("__start") / slice_us))
    k = [F.col(n) for n in names]

    part = _islands(d.repartition(*names, "__slice"), [*k, F.col("__slice")], gap_us)
    part = part.groupBy(*names, "__slice", "__n").agg(F.min("__start").alias("__start"), F.max("__end").alias("__end"), F.sum("__events").alias("__events"))
    last = F.max("__n").over(W.partitionBy(*names, "__slice"))
    # Sessions inside a slice keep to themselves, as gaps part them already; those at its ends form one group per key.
    edge = (F.col("__n") == 1) | (F.col("__n") == last)
    part = part.withColumn("__group", F.when(~edge, F.col("__slice"))).select(*names, "__group", "__start", "__end", "__events")
    joined = _islands(part, [*k, F.col("__group")], gap_us)
    whole = joined.groupBy(*names, "__group", "__n").agg(F.min("__start").alias("__start"), F.max("__end").alias("__end"), F.sum("__events").alias("__events"))
    return whole.select(
        *[F.col(n).alias(key) for key, n in zip(keys, names)],
        F.col("__start").alias("start_us"),
        F.col("__end").alias("end_us"),
        (F.col("__end") - F.col("__start")).alias("duration_us"),
        F.col("__events").alias("n_events"),
    )
