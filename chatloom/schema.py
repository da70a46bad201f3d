"""Schemas of messages and of the raw records of each platform."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions.text import not_blank

ID = T.DecimalType(20, 0)  # holds every unsigned 64-bit number

#: The six fields of a message.
MESSAGE_FIELDS = T.StructType(
    [
        T.StructField("sender", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("id", ID),
        T.StructField("reply_to", ID),
        T.StructField("edited", T.TimestampType()),
    ]
)
#: A message with its chat and its place in it, which stand for a list's order and are never written out.
MESSAGE_SCHEMA = T.StructType([T.StructField("chat_id", T.StringType()), T.StructField("seq", T.LongType()), *MESSAGE_FIELDS.fields])
MESSAGE_COLUMNS = MESSAGE_SCHEMA.names

TELEGRAM_RECORD = "STRUCT<id: DECIMAL(20,0), type: STRING, date_unixtime: STRING, `from`: STRING, text: VARIANT, reply_to_message_id: DECIMAL(20,0), edited_unixtime: STRING>"
INSTAGRAM_RECORD = (
    "STRUCT<sender_name: STRING, timestamp_ms: BIGINT, content: STRING, share: STRUCT<share_text: STRING, link: STRING>, "
    "photos: ARRAY<STRUCT<uri: STRING>>, videos: ARRAY<STRUCT<uri: STRING>>, audio_files: ARRAY<STRUCT<uri: STRING>>>"
)
DISCORD_RECORD = (
    "STRUCT<id: STRING, timestamp: STRING, timestampEdited: STRING, content: STRING, author: STRUCT<name: STRING, nickname: STRING>, "
    "reference: STRUCT<messageId: STRING>, attachments: ARRAY<STRUCT<fileName: STRING>>, stickers: ARRAY<STRUCT<name: STRING>>>"
)
# Of which JSON types a record's fields may be; a field that is absent may be so only where null is among them.
_TEXT, _TEXT_OR_NULL, _NUMBER_OR_NULL = {"STRING"}, {"STRING", "VOID"}, {"BIGINT", "VOID"}
STRICT = {
    "Telegram": {"type": _TEXT, "date_unixtime": _TEXT_OR_NULL, "from": _TEXT_OR_NULL, "edited_unixtime": _TEXT_OR_NULL, "id": _NUMBER_OR_NULL, "reply_to_message_id": _NUMBER_OR_NULL},
    "Instagram": {"sender_name": _TEXT, "timestamp_ms": {"BIGINT"}, "content": _TEXT_OR_NULL, "share.link": _TEXT_OR_NULL, "share.share_text": _TEXT_OR_NULL},
    "Discord": {
        "id": _TEXT, "timestamp": _TEXT, "content": _TEXT, "author.name": _TEXT, "author.nickname": _TEXT_OR_NULL, "timestampEdited": _TEXT_OR_NULL, "reference.messageId": _TEXT_OR_NULL,
    },
}


def message(sender: Column, content: Column, timestamp: Column | None = None, id: Column | None = None, reply_to: Column | None = None, edited: Column | None = None) -> Column:
    """A struct of the six fields; those not given are null."""
    stamp = lambda c: (F.lit(None) if c is None else c).cast("timestamp")
    number = lambda c: (F.lit(None) if c is None else c).cast(ID)
    return F.struct(
        sender.alias("sender"), content.alias("content"), stamp(timestamp).alias("timestamp"), number(id).alias("id"), number(reply_to).alias("reply_to"), stamp(edited).alias("edited"),
    )


def is_empty() -> Column:
    """Whether a message's content is blank."""
    return ~not_blank(F.col("content"))


def has_metadata() -> Column:
    """Whether a message has any of time, identifier, reply and edit."""
    return F.coalesce(F.col("timestamp").isNotNull() | F.col("id").isNotNull() | F.col("reply_to").isNotNull() | F.col("edited").isNotNull(), F.lit(False))


def from_rows(spark: SparkSession, rows: list[dict], chat_id: str = "chat") -> DataFrame:
    """Messages from dictionaries, in their order; absent fields are null, absent texts empty."""
    number = lambda x: None if x is None else Decimal(x)
    data = [
        (r.get("chat_id", chat_id), i, r.get("sender", ""), r.get("content", ""), r.get("timestamp"), number(r.get("id")), number(r.get("reply_to")), r.get("edited"))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, MESSAGE_SCHEMA)


def to_model_json(df: DataFrame) -> DataFrame:
    """``chat_id, seq, json``: each message as an object without its null fields, instants in RFC 3339."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(c)
    return df.select("chat_id", "seq", F.to_json(F.struct("sender", "content", stamp("timestamp"), "id", "reply_to", stamp("edited"))).alias("json"))


def from_model_json(df: DataFrame) -> DataFrame:
    """The inverse of :func:`to_model_json`."""
    return df.select("chat_id", "seq", F.from_json("json", MESSAGE_FIELDS).alias("m")).select("chat_id", "seq", "m.*")
