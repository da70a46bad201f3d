"""Exports that keep arriving in a folder, as streams of messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatloom.config import Platform, StreamingConfig
from chatloom.sources.files import create_source
from chatloom.sources.parsers import PARSERS, checked_records, discord_message, parse_chat

__all__ = ["stream_raw", "stream_chat", "stream_discord_jsonl", "process_stream"]


def stream_raw(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """``chat_id, raw, path`` of files as they arrive, at most *max_files* per micro-batch."""
    d = spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", max_files).format("text").load(folder)
    path = F.col("_metadata.file_path")
    d = d.select(path.alias("chat_id"), F.col("value").alias("raw"), path.alias("path"), F.col("_metadata.file_size").alias("size"))
    return d.observe("chatloom", F.sum("size").alias("chatloom_bytes")).drop("size")


def stream_chat(spark: SparkSession, folder: str, platform: Platform | str, config: StreamingConfig = StreamingConfig(), max_files: int = 64) -> DataFrame:
    """Messages of Telegram, Instagram or Discord JSON files, as one streaming DataFrame.

    Records parse one by one, bad ones are skipped (or, as configured, end the stream). Documents of lines need an
    order within the file, which a stream has none of: use :func:`process_stream` for them.
    """
    p = Platform.from_name(platform)
    source = create_source(p, streaming=True)
    options = source.config.with_(max_message_size=config.max_message_size)
    parser = PARSERS[p] if p is not Platform.DISCORD else None
    if parser is None:
        from chatloom.sources.parsers import parse_discord_json as parser
    if p is Platform.WHATSAPP:
        raise ValueError("WhatsApp files are read with process_stream")
    return parser(stream_raw(spark, folder, max_files), options, on_error="skip" if config.skip_invalid else "fail", profile="streaming")


def stream_discord_jsonl(spark: SparkSession, folder: str, max_files: int = 64) -> DataFrame:
    """Messages of files with a record per line: ``chat_id`` and the message, without a place."""
    d = spark.readStream.schema("value string").option("maxFilesPerTrigger", max_files).format("text").load(folder)
    r = F.when(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull(), F.col("value"))
    d = checked_records(d.select(F.col("_metadata.file_path").alias("chat_id"), r.alias("r")).where(F.col("r").isNotNull()), "Discord", "skip")
    return d.select("chat_id", discord_message(F.col("r"), stream="jsonl").alias("m")).where(F.col("m").isNotNull()).select("chat_id", "m.*")


def process_stream(spark: SparkSession, folder: str, platform: Platform | str, sink: Callable[[DataFrame, int], None], checkpoint: str, profile: str = "streaming", max_files: int = 64, **trigger) -> StreamingQuery:
    """Every micro-batch of files parsed as a batch and given to *sink* with its number; any platform and profile.

    Files are the units of arrival: a chat's lines are all in its file, so no state passes between micro-batches.
    """
    p = Platform.from_name(platform)

    def each(batch: DataFrame, number: int) -> None:
        sink(parse_chat(batch, p, profile=profile, on_error="skip"), number)

    q = stream_raw(spark, folder, max_files).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return q.trigger(**(trigger or {"availableNow": True})).start()
