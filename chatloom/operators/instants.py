"""Stamps of the raw exports against the stored message times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.instants import epoch_instant, with_instant

__all__ = ["raw_instants", "message_instants", "stamp_mismatches"]


def raw_instants(telegram: DataFrame, discord: DataFrame, instagram: DataFrame, chats: DataFrame) -> DataFrame:
    """``src, rec_id, chat_id, seq, instant``: one row per raw record, ``instant`` null where its stamp states none.

    *chats* gives each chat's ``export_tz`` and ``date_order``; Spark broadcasts it while it is below the session's
    threshold and joins by shuffle beyond that. Records of an unknown chat keep stamps that carry their own zone.
    """
    zones = chats.select("chat_id", "export_tz", "date_order")
    texts = telegram.select(F.lit("telegram_raw").alias("src"), "rec_id", "chat_id", "seq", F.col("date_unixtime").alias("stamp")).unionByName(
        discord.select(F.lit("discord_raw").alias("src"), "rec_id", "chat_id", "seq", F.col("timestamp").alias("stamp"))
    )
    texts = with_instant(texts.join(zones, "chat_id", "left"), "stamp", "export_tz", "date_order", "instant")
    keep = ["src", "rec_id", "chat_id", "seq", "instant"]
    counts = instagram.select(
        F.lit("instagram_raw").alias("src"), "rec_id", "chat_id", "seq", epoch_instant(F.col("timestamp_ms")).alias("instant")
    )
    return reduce(DataFrame.unionByName, [texts.select(*keep), counts.select(*keep)])


def message_instants(raw: DataFrame) -> DataFrame:
    """``chat_id, seq, instant``: the instant of each message that any copy of its record states.

    Aggregated before the shuffle; copies that disagree give the earliest, rows without a key or an instant drop out.
    """
    keyed = raw.where(F.col("chat_id").isNotNull() & F.col("seq").isNotNull())
    # The test for null follows the aggregate: before it, Catalyst would push it down and inline the whole parser.
    return keyed.groupBy("chat_id", "seq").agg(F.min("instant").alias("instant")).where(F.col("instant").isNotNull())


def stamp_mismatches(raw: DataFrame, messages: DataFrame, tolerance_us: int = 1_000_000) -> DataFrame:
    """``chat_id, seq`` of messages whose stored time is null or *tolerance_us* or more off the stated instant.

    Copies of a message count once: it is a mismatch if any copy's time is.
    """
    stored = messages.select("chat_id", "seq", F.unix_micros("timestamp").alias("stored"))
    stored = stored.groupBy("chat_id", "seq").agg(F.min("stored").alias("low"), F.max("stored").alias("high"), F.count_if(F.col("stored").isNull()).alias("gaps"))
    stated = message_instants(raw).select("chat_id", "seq", F.unix_micros("instant").alias("us"))
    off = (F.col("gaps") > 0) | (F.abs(F.col("us") - F.col("low")) >= tolerance_us) | (F.abs(F.col("us") - F.col("high")) >= tolerance_us)
    return stated.join(stored, ["chat_id", "seq"]).where(off).select("chat_id", "seq")
