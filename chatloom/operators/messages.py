"""Filters, merging, statistics, projection and time-window chunks of messages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.config import FilterConfig, OutputConfig
from chatloom.functions.text import ascii_lower
from chatloom.operators.ordered import BUCKET, carried
from chatloom.session import cut_lineage

__all__ = ["filter_condition", "apply_filters", "merge_consecutive", "ProcessingStats", "processing_stats", "stats_row", "project", "chunk_by_time"]


def filter_condition(config: FilterConfig) -> Column | None:
    """The conjunction of the active conditions; null where nothing is active. A date condition excludes null times."""
    parts = []
    if config.sender is not None:
        parts.append(ascii_lower(F.col("sender")) == ascii_lower(F.lit(config.sender)))
    if config.after is not None:
        parts.append(F.col("timestamp") >= F.lit(config.after))
    if config.before is not None:
        parts.append(F.col("timestamp") <= F.lit(config.before))
    return reduce(and_, parts) if parts else None


def apply_filters(df: DataFrame, config: FilterConfig) -> DataFrame:
    """The messages that meet the conditions; all of them if none is active."""
    cond = filter_condition(config)
    return df if cond is None else df.where(cond)


def merge_consecutive(df: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Runs of neighbours (by ``seq`` within ``chat_id``) of one sender as one message each.

    Contents are joined by newlines, empty ones included; all other fields, ``seq`` too, are the first message's.
    Runs form within buckets of ``seq``; the first and the last of each bucket are then joined per chat, so a large chat
    is spread over many tasks. One shuffle by chat and bucket; the rest moves merged rows.

    Defined cases: a null sender equals another null; null contents are skipped by the join; no rows, no rows; columns
    beyond the message's are the first row's.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    d = df.select("chat_id", "seq", "sender", "content", row.alias("row")).withColumn("b", F.floor(F.col("seq") / bucket)).repartition("chat_id", "b")
    w = W.partitionBy("chat_id", "b").orderBy("seq")
    d = d.withColumns({"i": F.row_number().over(w), "p": F.lag("sender").over(w), "last": F.lead(F.lit(1)).over(w).isNull()})
    d = d.withColumn("cut", F.when((F.col("i") > 1) & F.col("sender").eqNullSafe(F.col("p")), 0).otherwise(1))
    d = d.withColumn("n", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = d.groupBy("chat_id", "b", "n").agg(
        F.min_by("row", "seq").alias("row"),
        F.expr("listagg(content, '\n') WITHIN GROUP (ORDER BY seq)").alias("text"),
        F.min("seq").alias("s"),
        F.min_by("sender", "seq").alias("sender"),
        F.bool_or(F.col("i") == 1).alias("head"),
        F.bool_or("last").alias("tail"),
    )
    # Runs inside a bucket are groups of their own; those at its ends meet in one group per chat.
    runs = runs.withColumn("g", F.when(~F.col("head") & ~F.col("tail"), F.col("s")))
    c = W.partitionBy("chat_id", "g").orderBy("s")
    joins = F.col("head") & F.col("g").isNull() & (F.row_number().over(c) > 1) & F.col("sender").eqNullSafe(F.lag("sender").over(c))
    runs = runs.withColumn("cut", F.when(joins, 0).otherwise(1))
    runs = runs.withColumn("n", F.sum("cut").over(c.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = runs.groupBy("chat_id", "g", "n").agg(F.min_by("row", "s").alias("row"), F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY s)").alias("text"))
    return out.select(*[(F.col("text") if c == "content" else F.col(f"row.`{c}`")).alias(c) for c in df.columns])


@dataclass(frozen=True)
class ProcessingStats:
    """How many messages came in, remained after the filter (where there was one) and after merging."""

    original: int = 0
    merged: int = 0
    filtered: int | None = None

    def with_filtered(self, n: int) -> ProcessingStats:
        return replace(self, filtered=n)

    @property
    def base(self) -> int:
        return self.original if self.filtered is None else self.filtered

    def compression_ratio(self) -> float:
        return 0.0 if self.base == 0 else (1 - self.merged / self.base) * 100

    def messages_saved(self) -> int:
        return max(0, self.base - self.merged)

    def merge_ratio(self) -> float:
        return 1.0 if self.base == 0 else self.merged / self.base

    def __str__(self) -> str:
        return f"{self.base} → {self.merged} messages ({self.compression_ratio():.1f}% reduction)"


def stats_row(original: DataFrame, merged: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """One row with the counts and the figures made of them; nothing is collected."""
    d = original.agg(F.count(F.lit(1)).alias("original")).crossJoin(merged.agg(F.count(F.lit(1)).alias("merged")))  # one row each
    if filtered is not None:
        d = d.crossJoin(filtered.agg(F.count(F.lit(1)).alias("filtered")))
    base = F.col("original") if filtered is None else F.col("filtered")
    ratio = F.when(base == 0, 0.0).otherwise((1 - F.try_divide("merged", base)) * 100)
    return d.withColumns({"compression_ratio": ratio, "messages_saved": F.greatest(base - F.col("merged"), F.lit(0)), "merge_ratio": F.when(base == 0, 1.0).otherwise(F.try_divide("merged", base))})


def processing_stats(original: DataFrame, merged: DataFrame, filtered: DataFrame | None = None) -> ProcessingStats:
    r = stats_row(original, merged, filtered).first()
    return ProcessingStats(r["original"], r["merged"], r["filtered"] if filtered is not None else None)


def project(df: DataFrame, config: OutputConfig = OutputConfig()) -> DataFrame:
    """Sender and content, and the fields that *config* names, in the model's order."""
    cols = ["sender", "content"]
    cols += [c for c, on in (("timestamp", config.timestamps), ("id", config.ids), ("reply_to", config.replies), ("edited", config.edited)) if on]
    return df.select(*cols)


def _fold(window_minutes: int):
    """The place that opened each row's chunk; rows come sorted by stretch and place, and only the open one is kept."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, opened = None, None, None
        for d in parts:
            found = []
            for k, s, seq, us in zip(d["chat_id"], d["stretch"], d["seq"], d["us"]):
                us = None if pd.isna(us) else int(us)
                if (k, s) != key:
                    key, start, opened = (k, s), us, seq
                elif us is not None and (start is None or int((us - start) / 60_000_000) > window_minutes):
                    start, opened = us, seq
                found.append(opened)
            yield pd.DataFrame({"c": d["chat_id"], "p": d["seq"], "start": pd.Series(found, index=d.index, dtype=object)})

    return run


def chunk_by_time(df: DataFrame, window_minutes: int) -> DataFrame:
    """``chat_id, chunk_no, id, text, sender, timestamp, message_ids``: chunks anchored at their first message's time.

    A message opens a chunk when it is more than *window_minutes* whole minutes after the chunk's start, or has a time
    while the start has none; one without a time joins the open chunk. Text is ``sender: content`` by lines.

    The rule is sequential, but a message later than the window after the latest time seen before it in its chat opens
    a chunk whatever came before. Chats are cut at these places first, by a running maximum that is kept in buckets of
    places, so what is folded in order is one burst of a chat; rows stream through the fold, which keeps the open chunk's
    start only. All this moves chat, place and time alone; texts meet their chunk by one join.
    """
    lean = df.select("chat_id", "seq", F.unix_micros("timestamp").alias("us"), F.floor(F.col("seq") / BUCKET).alias("b"))
    lean = cut_lineage(lean.repartition("chat_id", "b"))
    d = carried(lean, "chat_id", "b", "seq", F.col("us"), "seen", before=True)
    minutes = ((F.col("us") - F.col("seen")) / 60_000_000).cast("bigint")
    d = cut_lineage(d.withColumn("sure", F.when(F.col("us").isNotNull() & (F.col("seen").isNull() | (minutes > window_minutes)), F.col("seq"))).drop("seen"))
    d = carried(d, "chat_id", "b", "seq", F.col("sure"), "stretch")
    # Python sees places and times only, and says which place opened the chunk of each.
    d = d.select("chat_id", "stretch", "seq", "us", F.col("chat_id").alias("k"), F.col("stretch").alias("s"))
    d = d.repartition("k", "s").sortWithinPartitions("chat_id", "stretch", "seq").select("chat_id", F.col("stretch").cast("string").alias("stretch"), F.col("seq").cast("string").alias("seq"), "us")
    found = d.mapInPandas(_fold(window_minutes), "c string, p string, start string")
    found = found.select(F.col("c"), F.col("p").cast("bigint").alias("p"), F.col("start").cast("bigint").alias("start"))
    line = F.concat(F.coalesce("sender", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")))
    d = df.withColumn("__line", line).join(found, F.col("chat_id").eqNullSafe(F.col("c")) & F.col("seq").eqNullSafe(F.col("p")))
    out = d.groupBy("chat_id", "start").agg(
        F.expr("listagg(__line, '\n') WITHIN GROUP (ORDER BY seq)").alias("text"),
        F.min_by(F.struct("sender", "timestamp"), "seq").alias("__f"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("seq", "id")))), lambda x: x["id"]).alias("message_ids"),
    )
    out = out.withColumn("chunk_no", F.row_number().over(W.partitionBy("chat_id").orderBy("start")).cast("bigint") - 1)  # a row per chunk
    return out.select("chat_id", "chunk_no", F.concat(F.lit("chunk_"), "chunk_no").alias("id"), "text", "__f.sender", "__f.timestamp", "message_ids")
