"""Reading exports from files."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.config import CONFIGS, Platform
from chatloom.errors import InputOutputError
from chatloom.sources.json_array import JsonArraySource
from chatloom.sources.parsers import parse_chat, parse_records, parse_whatsapp_lines

__all__ = ["read_raw", "read_chat", "read_lines", "read_large", "parse_strings", "Source", "create_source", "submit"]

_POOL = ThreadPoolExecutor(max_workers=4, thread_name_prefix="chatloom")


def read_raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``chat_id, raw, path``: a row per file; several paths give one table, in which a chat is a file."""
    d = spark.read.text(paths, wholetext=True)
    path = F.col("_metadata.file_path")
    return d.select(path.alias("chat_id"), F.col("value").alias("raw"), path.alias("path"))


def read_chat(spark: SparkSession, paths: str | list[str], platform: Platform | str, config=None, **options) -> DataFrame:
    """The messages of export files."""
    try:
        raw = read_raw(spark, paths)
    except Exception as e:  # Spark names a missing path only by its own exception
        if "PATH_NOT_FOUND" in str(e):
            raise InputOutputError(str(e).split("\n")[0]) from e
        raise
    return parse_chat(raw, platform, config, **options)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``chat_id, line_no, line`` of text files of any size, read in blocks by many tasks.

    A line's number is the place of its block in the file and its own in the block; as a line has a byte at least, the
    numbers of later blocks are greater. They are unique and in order, not without gaps.
    """
    d = spark.read.option("lineSep", "\n").text(paths)
    d = d.select(F.col("_metadata.file_path").alias("chat_id"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    first = F.min("at").over(W.partitionBy("chat_id", "block"))
    return d.select("chat_id", (F.col("block") + F.col("at") - first).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def read_large(spark: SparkSession, path: str, platform: Platform | str, config=None, on_error: str = "skip", profile: str = "eager", max_record: int = 10 << 20) -> DataFrame:
    """The messages of exports too large to be a row each: JSON record by record, WhatsApp line by line.

    A JSON file is a partition, of which one record and one block are in memory at a time. Records larger than
    *max_record* are left out, or end the read where errors fail. Discord's text and CSV exports have no such way.
    """
    p = Platform.from_name(platform)
    if p is Platform.WHATSAPP:
        options = {} if config is None else {"config": config}
        return parse_whatsapp_lines(read_lines(spark, path), on_error=on_error, profile=profile, **options)
    spark.dataSource.register(JsonArraySource)
    d = spark.read.format("chat_json_array").option("maxRecordSize", max_record).option("oversize", on_error).load(path)
    return parse_records(d.where(F.col("item").isNotNull()), p, config, on_error, profile)


def parse_strings(spark: SparkSession, texts: str | list[str], platform: Platform | str, config=None, **options) -> DataFrame:
    """The messages of exports held in memory."""
    texts = [texts] if isinstance(texts, str) else texts
    raw = spark.createDataFrame([(f"text_{i}", t) for i, t in enumerate(texts)], "chat_id string, raw string")
    return parse_chat(raw, platform, config, **options)


@dataclass(frozen=True)
class Source:
    """A parser of a platform with its options."""

    platform: Platform
    config: object
    profile: str = "eager"

    @property
    def name(self) -> str:
        return str(self.platform)

    @property
    def supports_streaming(self) -> bool:
        """Whether a stream of files gives messages record by record; WhatsApp's lines need their whole file."""
        return self.platform is not Platform.WHATSAPP

    @property
    def recommended_buffer_size(self) -> int:
        return self.config.buffer_size

    def parse(self, spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
        return read_chat(spark, paths, self.platform, self.config, **{"profile": self.profile, **options})

    def stream_file(self, spark: SparkSession, path: str, **options) -> DataFrame:
        """The messages of a file of any size, in the streaming profile."""
        return read_large(spark, path, self.platform, self.config, **{"profile": "streaming", **options})

    def parse_str(self, spark: SparkSession, text: str, **options) -> DataFrame:
        return parse_strings(spark, text, self.platform, self.config, **{"profile": self.profile, **options})


def create_source(platform: Platform | str, config=None, streaming: bool = False) -> Source:
    """The source of a platform: with default options, those for streaming, or given ones."""
    p = Platform.from_name(platform)
    kind = CONFIGS[p]
    return Source(p, config or (kind.for_streaming() if streaming else kind()), "streaming" if streaming else "eager")


def submit(action, *args, **kwargs) -> Future:
    """Runs an action of Spark in a thread: ``submit(df.count)``."""
    return _POOL.submit(action, *args, **kwargs)
