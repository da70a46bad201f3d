"""Queries over the test tables for the export library's own operators, each with the same result in DuckDB's SQL.

Names begin with the kind of operator: f filter, m merge, s statistics, p projection, k sink, src source, x function,
a aggregation, c chunk, t stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatloom.config import FilterConfig, OutputConfig
from chatloom.functions import text as X
from chatloom.operators import messages as M
from chatloom.schema import MESSAGE_COLUMNS, from_model_json, from_rows, has_metadata, is_empty, to_model_json
from chatloom.session import read_table
from chatloom.sinks import writers as K
from chatloom.sources import parsers as S
from chatloom.sources.files import create_source

ALL = OutputConfig.all()


def _ids(df: DataFrame) -> DataFrame:
    """Numbers as text and instants as microseconds, which every engine compares alike."""
    return df.select(
        *[c for c in df.columns if c not in ("timestamp", "edited", "id", "reply_to")],
        F.unix_micros("timestamp").alias("timestamp_us"),
        F.col("id").cast("string").alias("id"),
        F.col("reply_to").cast("string").alias("reply_to"),
        F.unix_micros("edited").alias("edited_us"),
    )


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The event stream as chats: a user is a chat, the kind of event the sender."""
    e = read_table(spark, d, "events")
    null = F.lit(None)
    return e.select(
        F.col("user_id").cast("string").alias("chat_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("sender"), F.col("props").alias("content"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").cast("decimal(20,0)").alias("id"), null.cast("decimal(20,0)").alias("reply_to"), null.cast("timestamp").alias("edited"),
    )


_EVENTS = """(SELECT CAST(user_id AS VARCHAR) AS chat_id, event_id AS seq, event_type AS sender, props AS content, epoch_us(ts) AS timestamp_us, event_id AS id FROM events)"""
_MERGE = """(SELECT chat_id, MIN(seq) AS seq, ARG_MIN(struct_pack(s := sender), seq).s AS sender, coalesce(STRING_AGG(content, chr(10) ORDER BY seq), '') AS content, ARG_MIN(struct_pack(t := timestamp_us), seq).t AS timestamp_us, ARG_MIN(struct_pack(i := id), seq).i AS id
FROM (SELECT *, SUM(cut) OVER (PARTITION BY chat_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN sender IS NOT DISTINCT FROM LAG(sender) OVER w AND ROW_NUMBER() OVER w > 1 THEN 0 ELSE 1 END AS cut FROM {} WINDOW w AS (PARTITION BY chat_id ORDER BY seq))) GROUP BY chat_id, run)"""
_MSG = "chat_id, seq, sender, content, epoch_us(timestamp) AS timestamp_us, CAST(id AS VARCHAR) AS id, CAST(reply_to AS VARCHAR) AS reply_to, epoch_us(edited) AS edited_us"
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- filters ----------------------------------------------------------------------------------------------------


@_query(f"SELECT row_id, {_MSG} FROM messages WHERE {_AZ.format('sender')} = 'build bot'")
def f_sender(spark: SparkSession, d: str) -> DataFrame:
    m = M.apply_filters(read_table(spark, d, "messages"), FilterConfig().with_sender("BUILD bot"))
    return _ids(m.select("row_id", *MESSAGE_COLUMNS))


@_query(f"SELECT row_id, {_MSG} FROM messages WHERE timestamp >= TIMESTAMPTZ '2023-04-01 00:00:00+00' AND timestamp <= TIMESTAMPTZ '2023-09-30 23:59:59+00'")
def f_date_range(spark: SparkSession, d: str) -> DataFrame:
    m = M.apply_filters(read_table(spark, d, "messages"), FilterConfig().with_date_from("2023-04-01").with_date_to("2023-09-30"))
    return _ids(m.select("row_id", *MESSAGE_COLUMNS))


@_query(f"SELECT row_id, {_MSG} FROM messages WHERE timestamp >= TIMESTAMPTZ '2023-04-01 00:00:00+00' AND {_AZ.format('sender')} = 'night shift'")
def f_conjunction(spark: SparkSession, d: str) -> DataFrame:
    m = M.apply_filters(read_table(spark, d, "messages"), FilterConfig().with_after(FilterConfig().with_date_from("2023-04-01").after).with_user("Night Shift"))
    return _ids(m.select("row_id", *MESSAGE_COLUMNS))


@_query("SELECT platform, COUNT(*) AS n, COUNT(timestamp) AS stamped FROM messages JOIN chats USING (chat_id) WHERE timestamp <= TIMESTAMPTZ '2099-12-31 23:59:59+00' GROUP BY platform")
def f_null_times(spark: SparkSession, d: str) -> DataFrame:
    m = M.apply_filters(read_table(spark, d, "messages"), FilterConfig().before_date("2099-12-31"))
    chats = read_table(spark, d, "chats").select("chat_id", "platform")
    return m.join(chats, "chat_id").groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("stamped"))


@_query(r"SELECT row_id, chat_id, seq FROM messages WHERE content IS NOT NULL AND regexp_matches(content, '[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]')")
def f_not_blank(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "messages").where(X.not_blank(F.col("content"))).select("row_id", "chat_id", "seq")


# ---- merge, statistics, chunks ----------------------------------------------------------------------------------


def _merged(df: DataFrame) -> DataFrame:
    return _ids(M.merge_consecutive(df)).select("chat_id", "seq", "sender", "content", "timestamp_us", "id")


_OUT = "SELECT chat_id, seq, sender, content, timestamp_us, CAST(id AS VARCHAR) AS id FROM "


@_query(_OUT + _MERGE.format(_EVENTS))
def m_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(_events(spark, d))


@_query(_OUT + _MERGE.format(f"(SELECT * FROM {_EVENTS} WHERE timestamp_us >= 1705276800000000)"))
def m_filter_then_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(M.apply_filters(_events(spark, d), FilterConfig().with_date_from("2024-01-15")))


@_query(_OUT + f"(SELECT * FROM {_MERGE.format(_EVENTS)} WHERE timestamp_us >= 1705276800000000)")
def m_merge_then_filter(spark: SparkSession, d: str) -> DataFrame:
    m = M.apply_filters(M.merge_consecutive(_events(spark, d)), FilterConfig().with_date_from("2024-01-15"))
    return _ids(m).select("chat_id", "seq", "sender", "content", "timestamp_us", "id")


_ONCE = "(SELECT chat_id, seq, ARG_MIN(struct_pack(s := sender), row_id).s AS sender, ARG_MIN(struct_pack(c := content), row_id).c AS content, ARG_MIN(struct_pack(t := epoch_us(timestamp)), row_id).t AS timestamp_us, ARG_MIN(struct_pack(i := id), row_id).i AS id FROM messages GROUP BY chat_id, seq)"


@_query(_OUT + _MERGE.format(_ONCE))
def m_merge_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages with null and blank senders and contents, the first copy of each."""
    m = read_table(spark, d, "messages")
    once = m.groupBy("chat_id", "seq").agg(F.min_by(F.struct(*MESSAGE_COLUMNS[2:]), "row_id").alias("m")).select("chat_id", "seq", "m.*")
    return _merged(once)


@_query(f"""SELECT original, merged, filtered, round((1 - merged / filtered) * 100, 6) AS compression_ratio, greatest(filtered - merged, 0) AS messages_saved, round(merged / filtered, 6) AS merge_ratio
FROM (SELECT (SELECT COUNT(*) FROM events) AS original, (SELECT COUNT(*) FROM {_EVENTS} WHERE timestamp_us >= 1705276800000000) AS filtered, (SELECT COUNT(*) FROM {_MERGE.format(f"(SELECT * FROM {_EVENTS} WHERE timestamp_us >= 1705276800000000)")}) AS merged)""")
def s_stats_filtered(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    f = M.apply_filters(e, FilterConfig().with_date_from("2024-01-15"))
    r = M.stats_row(e, M.merge_consecutive(f), f)
    return r.withColumns({"compression_ratio": F.round("compression_ratio", 6), "merge_ratio": F.round("merge_ratio", 6)})


@_query(f"""SELECT original, merged, round((1 - merged / original) * 100, 6) AS compression_ratio, original - merged AS messages_saved, round(merged / original, 6) AS merge_ratio
FROM (SELECT (SELECT COUNT(*) FROM events) AS original, (SELECT COUNT(*) FROM {_MERGE.format(_EVENTS)}) AS merged)""")
def s_stats(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    r = M.stats_row(e, M.merge_consecutive(e))
    return r.withColumns({"compression_ratio": F.round("compression_ratio", 6), "merge_ratio": F.round("merge_ratio", 6)})


@_query(
    f"""WITH RECURSIVE r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY seq) AS i FROM {_EVENTS}), f AS (
SELECT chat_id, i, timestamp_us AS start, 0 AS chunk_no FROM r WHERE i = 1 UNION ALL
SELECT r.chat_id, r.i, CASE WHEN (r.timestamp_us - f.start) // 60000000 > 60 THEN r.timestamp_us ELSE f.start END, f.chunk_no + CASE WHEN (r.timestamp_us - f.start) // 60000000 > 60 THEN 1 ELSE 0 END
FROM f JOIN r ON r.chat_id = f.chat_id AND r.i = f.i + 1)
SELECT chat_id, CAST(chunk_no AS BIGINT) AS chunk_no, 'chunk_' || chunk_no AS id, STRING_AGG(coalesce(sender, '') || ': ' || coalesce(content, ''), chr(10) ORDER BY seq) AS text, ARG_MIN(sender, seq) AS sender,
ARG_MIN(timestamp_us, seq) AS timestamp_us, STRING_AGG(CAST(id AS VARCHAR), ',' ORDER BY seq) AS ids FROM f JOIN r USING (chat_id, i) GROUP BY chat_id, chunk_no"""
)
def c_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of an hour."""
    c = M.chunk_by_time(_events(spark, d), 60)
    return c.select("chat_id", "chunk_no", "id", "text", "sender", F.unix_micros("timestamp").alias("timestamp_us"), F.array_join(F.col("message_ids").cast("array<string>"), ",").alias("ids"))


# ---- projection and sinks ---------------------------------------------------------------------------------------

_TS = "strftime(timezone('UTC', {}), '%Y-%m-%d %H:%M:%S')"
_Q = "CASE WHEN regexp_matches({0}, '[;\"\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE coalesce({0}, '') END"


@_query(f"SELECT row_id, CAST(id AS VARCHAR) AS id, {_TS.format('timestamp')} AS timestamp, sender, content, CAST(reply_to AS VARCHAR) AS reply_to, {_TS.format('edited')} AS edited FROM messages")
def p_output(spark: SparkSession, d: str) -> DataFrame:
    """Row numbers ride in the place of the chat, so that rows can be told apart behind the projection."""
    m = read_table(spark, d, "messages").withColumn("sender", F.struct("sender", "row_id"))
    p = M.project(m, ALL).select(F.col("sender.row_id").alias("row_id"), F.col("sender.sender").alias("sender"), "content", "timestamp", "id", "reply_to", "edited")
    return p.withColumns({"timestamp": X.stamp_text(F.col("timestamp")), "edited": X.stamp_text(F.col("edited")), "id": F.col("id").cast("string"), "reply_to": F.col("reply_to").cast("string")})


@_query("SELECT sender, content, COUNT(*) AS n FROM messages GROUP BY sender, content")
def p_default(spark: SparkSession, d: str) -> DataFrame:
    return M.project(read_table(spark, d, "messages")).groupBy("sender", "content").agg(F.count(F.lit(1)).alias("n"))


@_query(
    "SELECT chat_id, seq, coalesce(CAST(id AS VARCHAR), '') || ';' || coalesce(" + _TS.format("timestamp") + ", '') || ';' || " + _Q.format("sender") + " || ';' || " + _Q.format("content")
    + " || ';' || coalesce(CAST(reply_to AS VARCHAR), '') || ';' || coalesce(" + _TS.format("edited") + ", '') AS line FROM messages"
)
def k_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return K.csv_lines(read_table(spark, d, "messages"), ALL)


_JTS = "strftime(timezone('UTC', {}), '%Y-%m-%dT%H:%M:%SZ')"


@_query(f"SELECT row_id, sender, content, {_JTS.format('timestamp')} AS timestamp, CAST(id AS VARCHAR) AS id, CAST(reply_to AS VARCHAR) AS reply_to, {_JTS.format('edited')} AS edited FROM messages")
def k_jsonl_fields(spark: SparkSession, d: str) -> DataFrame:
    """Lines written and read again."""
    m = read_table(spark, d, "messages")
    lines = K.jsonl_lines(m.withColumn("seq", F.col("row_id")), ALL)
    f = F.from_json("line", "sender string, content string, timestamp string, id decimal(20,0), reply_to decimal(20,0), edited string")
    return lines.select(F.col("seq").alias("row_id"), f.alias("f")).select("row_id", "f.*").withColumns({c: F.col(c).cast("string") for c in ("id", "reply_to")})


@_query(f"SELECT row_id, sender, content, {_JTS.format('timestamp')} AS timestamp FROM messages")
def k_json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Pretty-printed objects written and read again."""
    m = read_table(spark, d, "messages").withColumn("seq", F.col("row_id"))
    lines = K.json_objects(m, OutputConfig(timestamps=True), pretty=True)
    return lines.select(F.col("seq").alias("row_id"), F.from_json("line", "sender string, content string, timestamp string").alias("f")).select("row_id", "f.*")


# ---- sources ----------------------------------------------------------------------------------------------------


def _stamp_us(df: DataFrame) -> DataFrame:
    return _ids(df)


_U64 = "CASE WHEN regexp_full_match({0}, '\\+?[0-9]+') THEN CASE WHEN TRY_CAST({0} AS HUGEINT) <= 18446744073709551615 THEN CAST(TRY_CAST({0} AS HUGEINT) AS VARCHAR) END END"
_RFC = "CASE WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[Tt ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]+)?([Zz]|[+-][0-9]{{2}}:[0-9]{{2}})') THEN epoch_us(TRY_CAST(regexp_replace({0}, '(\\.[0-9]{{6}})[0-9]+', '\\1') AS TIMESTAMPTZ)) END"
_UNIX = "CASE WHEN regexp_full_match({0}, '[+-]?[0-9]+') AND TRY_CAST({0} AS BIGINT) BETWEEN -62135596800 AND 253402300799 THEN TRY_CAST({0} AS BIGINT) * 1000000 END"
_FLAT = """CASE WHEN json_valid(text) THEN CASE json_type(text) WHEN 'VARCHAR' THEN text ->> '$' WHEN 'ARRAY' THEN
coalesce(array_to_string(list_filter(list_transform(CAST(CAST(text AS JSON) AS JSON[]), lambda e: CASE json_type(e) WHEN 'VARCHAR' THEN e ->> '$' WHEN 'OBJECT' THEN CASE WHEN json_type(e, '$.text') = 'VARCHAR' THEN e ->> '$.text' END END), lambda x: x IS NOT NULL), ''), '') ELSE '' END END"""
_SOLID = r"regexp_matches({}, '[^\s\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x0B]')"


@_query(
    f"""SELECT rec_id, chat_id, seq, sender, content, timestamp_us, id, reply_to, edited_us FROM (SELECT rec_id, chat_id, seq, from_name AS sender, {_FLAT} AS content, {_UNIX.format('date_unixtime')} AS timestamp_us,
CAST(id AS VARCHAR) AS id, CAST(reply_to_message_id AS VARCHAR) AS reply_to, {_UNIX.format('edited_unixtime')} AS edited_us FROM telegram_raw WHERE type = 'message' AND from_name IS NOT NULL AND text IS NOT NULL)
WHERE content IS NOT NULL AND {_SOLID.format('content')}"""
)
def src_telegram(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "telegram_raw")
    r = F.struct(F.col("id").cast("decimal(20,0)").alias("id"), "type", "date_unixtime", F.col("from_name").alias("from"), F.try_parse_json("text").alias("text"), F.col("reply_to_message_id").cast("decimal(20,0)").alias("reply_to_message_id"), "edited_unixtime")
    return _message_rows(t, S.telegram_message, r)


def _message_rows(raw: DataFrame, parse, r: Column) -> DataFrame:
    x = raw.select("rec_id", "chat_id", "seq", r.alias("r"))
    x = x.select("rec_id", "chat_id", "seq", parse(F.col("r")).alias("m")).where(F.col("m").isNotNull())
    return _stamp_us(x.select("rec_id", "chat_id", "seq", "m.*"))


@_query(
    f"""SELECT rec_id, chat_id, seq, sender_name AS sender, c AS content, CASE WHEN timestamp_ms BETWEEN -62135596800000 AND 253402300799999 THEN timestamp_ms * 1000 END AS timestamp_us, CAST(NULL AS VARCHAR) AS id,
CAST(NULL AS VARCHAR) AS reply_to, CAST(NULL AS BIGINT) AS edited_us FROM (SELECT *, coalesce(content, share.share_text) AS c FROM instagram_raw) WHERE c IS NOT NULL AND {_SOLID.format('c')}"""
)
def src_instagram(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "instagram_raw")
    return _message_rows(t, lambda r: S.instagram_message(r, fix_encoding=False), F.struct("sender_name", "timestamp_ms", "content", "share"))


_LINES = "array_to_string(list_filter(list_concat(CASE WHEN coalesce(content, '') <> '' THEN [content] ELSE [] END, coalesce(list_transform(coalesce(attachments, []), lambda a: '[Attachment: ' || a.fileName || ']'), []), coalesce(list_transform(coalesce(stickers, []), lambda s: '[Sticker: ' || s.name || ']'), [])), lambda x: x IS NOT NULL), chr(10))"


@_query(
    f"""SELECT rec_id, chat_id, seq, coalesce(author.nickname, author.name) AS sender, {_LINES} AS content, {_RFC.format('timestamp')} AS timestamp_us, {_U64.format('id')} AS id,
{_U64.format('reference.messageId')} AS reply_to, {_RFC.format('timestamp_edited')} AS edited_us FROM discord_raw
WHERE coalesce({_SOLID.format('content')}, false) OR coalesce(len(attachments), 0) > 0 OR coalesce(len(stickers), 0) > 0"""
)
def src_discord_json(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "discord_raw")
    r = F.struct("id", "timestamp", F.col("timestamp_edited").alias("timestampEdited"), "content", "author", "reference", "attachments", "stickers")
    return _message_rows(t, S.discord_message, r)


_EN = "[" + ", ".join("'" + p.lower().replace("'", "''") + "'" for p in X.NOTICES_EN) + "]"
_RU = "[" + ", ".join(f"'{p}'" for p in X.NOTICES_RU) + "]"
_NOTICE = f"(list_bool_or(list_transform({_EN}, lambda p: contains(lower({{c}}), p))) OR list_bool_or(list_transform({_RU}, lambda p: contains({{c}}, p))))"
_WHITE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+"
_DOC_LINES = "list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: " + _SOLID.format("x") + ")"


def _documents(spark: SparkSession, d: str, head: Column) -> DataFrame:
    t = read_table(spark, d, "documents").where(F.col("text").isNotNull())
    return t.select(F.col("doc_id").cast("string").alias("chat_id"), F.concat(head, F.col("text")).alias("raw"))


_FIRST = "string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[1]"
_REST = "list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[2:], lambda x: " + _SOLID.format("x") + ")"


@_query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS chat_id, 'Alice' AS sender, array_to_string(list_concat([regexp_replace(first, '^[\\s\\x{{00A0}}]', '')], rest), chr(10)) AS content, 1705314645000000 AS timestamp_us
FROM (SELECT doc_id, {_FIRST} AS first, {_REST} AS rest FROM documents WHERE text IS NOT NULL) WHERE NOT {_NOTICE.format(c='first')}"""
)
def src_whatsapp(spark: SparkSession, d: str) -> DataFrame:
    """Each document as an export of one message of many lines; notices and blank lines fall away."""
    m = S.parse_whatsapp(_documents(spark, d, F.lit("[15.01.24, 10:30:45] Alice:")))
    return m.select("chat_id", "sender", "content", F.unix_micros("timestamp").alias("timestamp_us"))


@_query(
    f"""SELECT chat_id, 'Alice' AS sender, text AS content, 1705314645000000 AS timestamp_us FROM (SELECT chat_id, regexp_replace(array_to_string(list_concat([first], list_transform(rest, lambda x: regexp_replace(x, '{_WHITE}$', ''))), chr(10)), '^{_WHITE}|{_WHITE}$', '', 'g') AS text
FROM (SELECT CAST(doc_id AS VARCHAR) AS chat_id, {_FIRST} AS first, {_REST} AS rest FROM documents WHERE text IS NOT NULL)) WHERE {_SOLID.format('text')} AND NOT {_NOTICE.format(c='text')}"""
)
def src_whatsapp_stream(spark: SparkSession, d: str) -> DataFrame:
    m = S.parse_whatsapp(_documents(spark, d, F.lit("[15.01.24, 10:30:45] Alice: ")), profile="streaming")
    return m.select("chat_id", "sender", "content", F.unix_micros("timestamp").alias("timestamp_us"))


@_query(
    f"""SELECT CAST(doc_id AS VARCHAR) AS chat_id, 'Alice' AS sender, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^{_WHITE}|{_WHITE}$', '', 'g') AS content, 1705314600000000 AS timestamp_us
FROM documents WHERE text IS NOT NULL AND {_SOLID.format('text')}"""
)
def src_discord_txt(spark: SparkSession, d: str) -> DataFrame:
    """Each document as an export of one message."""
    m = S.parse_discord_txt(_documents(spark, d, F.lit("[1/15/2024 10:30 AM] Alice\n")))
    return m.select("chat_id", "sender", "content", F.unix_micros("timestamp").alias("timestamp_us"))


@_query("SELECT CAST(doc_id AS VARCHAR) AS chat_id, coalesce(source, '') AS sender, text AS content, 1705314645000000 AS timestamp_us FROM documents WHERE text IS NOT NULL AND " + _SOLID.format("text"))
def src_discord_csv(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a CSV export of one message, quotes and line ends in it."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    t = read_table(spark, d, "documents").where(F.col("text").isNotNull())
    row = F.concat_ws(",", F.lit('"1"'), q(F.col("source")), F.lit("2024-01-15T10:30:45+00:00"), q(F.col("text")), F.lit(""), F.lit(""))
    raw = t.select(F.col("doc_id").cast("string").alias("chat_id"), F.concat(F.lit("AuthorID,Author,Date,Content,Attachments,Reactions\n"), row, F.lit("\n")).alias("raw"))
    return S.parse_discord_csv(raw).select("chat_id", "sender", "content", F.unix_micros("timestamp").alias("timestamp_us"))


@_query(
    "SELECT CAST(doc_id AS VARCHAR) AS chat_id, CASE WHEN doc_id % 5 = 0 THEN 'US' WHEN doc_id % 5 = 1 THEN 'EuDotBracketed' WHEN doc_id % 5 = 2 THEN 'EuDotNoBracket' WHEN doc_id % 5 = 3 THEN 'EuSlash' ELSE 'US' END AS format FROM documents WHERE text IS NOT NULL"
)
def a_format_vote(spark: SparkSession, d: str) -> DataFrame:
    """One of five line formats per document; bracketed day-first slashes look like the first and lose the tie."""
    heads = ["[1/15/24, 10:30 AM] A: ", "[15.01.24, 10:30] A: ", "15.01.2024, 10:30 - A: ", "15/01/2024, 10:30 - A: ", "[15/01/2024, 10:30:45] A: "]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % 5 + 1).cast("int"))
    return S.whatsapp_format(S._lines(_documents(spark, d, head)))


# ---- functions --------------------------------------------------------------------------------------------------


@_query(
    """SELECT rec_id, CASE WHEN content IS NULL THEN NULL WHEN NOT regexp_matches(content, '[^\\x00-\\x7F]') THEN content ELSE
coalesce(TRY(decode(unhex(list_aggregate(list_transform(string_split(content, ''), lambda c: printf('%02x', ord(c) & 255)), 'string_agg', '')))), content) END AS repaired FROM instagram_raw"""
)
def x_mojibake(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "instagram_raw").select("rec_id", X.low_byte_repair(F.col("content")).alias("repaired"))


@_query(f"SELECT row_id, coalesce({_NOTICE.format(c='content')}, false) OR trim(sender, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) = '' OR contains(lower(sender), 'whatsapp') OR contains(lower(sender), 'system') AS notice FROM (SELECT row_id, coalesce(sender, '') AS sender, content FROM messages)")
def x_notice(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "messages")
    return m.select("row_id", F.coalesce(X.is_notice(F.coalesce("sender", F.lit("")), F.col("content")), F.lit(False)).alias("notice"))


@_query(f"SELECT rec_id, {_U64.format('id')} AS id FROM discord_raw")
def x_u64(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "discord_raw").select("rec_id", X.u64(F.col("id")).cast("string").alias("id"))


@_query(f"SELECT rec_id, {_RFC.format('timestamp')} AS timestamp_us FROM discord_raw")
def x_rfc3339(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "discord_raw").select("rec_id", F.unix_micros(X.rfc3339(F.col("timestamp"))).alias("timestamp_us"))


@_query(f"SELECT rec_id, {_UNIX.format('date_unixtime')} AS timestamp_us FROM telegram_raw")
def x_unix_seconds(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "telegram_raw").select("rec_id", F.unix_micros(X.unix_seconds(F.col("date_unixtime"))).alias("timestamp_us"))


@_query(f"SELECT rec_id, {_LINES} AS content FROM discord_raw")
def x_placeholders(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "discord_raw")
    none = F.array().cast("array<string>")
    files = F.coalesce(F.transform("attachments", lambda a: a["fileName"]), none)
    return t.select("rec_id", X.append_lines(F.col("content"), X.attachment_lines(files), X.sticker_lines(F.coalesce(F.transform("stickers", lambda s: s["name"]), none))).alias("content"))


# ---- documents of many messages, made of the raw tables and of messages --------------------------------------------

PER_DOCUMENT = 500


def _json(c) -> Column:
    """A value as JSON, null as null."""
    a = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.substring(a, F.lit(2), F.length(a) - 2)


def _object(**fields: Column) -> Column:
    parts = [F.concat(F.lit(("" if i == 0 else ",") + f'"{k}":'), v) for i, (k, v) in enumerate(fields.items())]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _bundled(t: DataFrame, key: str, record: Column, head: str = '{"messages": [', sep: str = ",", tail: str = "]}") -> DataFrame:
    """``chat_id, raw``: the records of every PER_DOCUMENT keys as one document, in the order of their key."""
    d = t.select(F.floor(F.col(key) / PER_DOCUMENT).cast("string").alias("chat_id"), F.col(key).alias("k"), record.alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]), sep)
    return d.groupBy("chat_id").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("raw"))


_PLACE = f"CAST(CAST(floor({{0}} / {PER_DOCUMENT}) AS BIGINT) AS VARCHAR) AS chat_id, ROW_NUMBER() OVER (PARTITION BY floor({{0}} / {PER_DOCUMENT}) ORDER BY {{0}}) - 1 AS seq"


def _telegram_documents(spark: SparkSession, d: str, broken: bool = False) -> DataFrame:
    t = read_table(spark, d, "telegram_raw")
    text = F.coalesce(F.when(F.try_parse_json("text").isNotNull(), F.col("text")), F.lit("null"))
    record = _object(
        id=_json("id"), type=_json(F.coalesce("type", F.lit("service"))), date_unixtime=_json("date_unixtime"), text=text, reply_to_message_id=_json("reply_to_message_id"), edited_unixtime=_json("edited_unixtime"),
        **{"from": F.when(F.col("rec_id") % 10 == 7, "5").otherwise(_json("from_name")) if broken else _json("from_name")},
    )
    return _bundled(t, "rec_id", record)


_TG = f"""SELECT chat_id, seq, sender, content, timestamp_us, id, reply_to, edited_us FROM (SELECT {_PLACE.format('rec_id')}, rec_id, type, text, from_name AS sender, {_FLAT} AS content, {_UNIX.format('date_unixtime')} AS timestamp_us,
CAST(id AS VARCHAR) AS id, CAST(reply_to_message_id AS VARCHAR) AS reply_to, {_UNIX.format('edited_unixtime')} AS edited_us FROM telegram_raw) WHERE type = 'message' AND sender IS NOT NULL AND text IS NOT NULL AND content IS NOT NULL AND {_SOLID.format('content')}"""


@_query(_TG)
def src_telegram_documents(spark: SparkSession, d: str) -> DataFrame:
    return _ids(S.parse_telegram(_telegram_documents(spark, d)))


@_query(_TG + " AND rec_id % 10 <> 7")
def src_telegram_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth record has a number for a sender, which is malformed: it alone is skipped."""
    return _ids(S.parse_telegram(_telegram_documents(spark, d, broken=True), profile="streaming"))


@_query("SELECT * FROM (VALUES (0, 'A', 'x'), (2, 'B', 'y z')) AS t(seq, sender, content)")
def src_strings(spark: SparkSession, d: str) -> DataFrame:
    """An export held in memory, by the platform's short name."""
    text = '{"messages":[{"id":1,"type":"message","from":"A","text":"x"},{"id":2,"type":"service","from":"A","text":"x"},{"id":3,"type":"message","from":"B","text":["y ",{"type":"bold","text":"z"}]}]}'
    return create_source("tg").parse_str(spark, text).select("seq", "sender", "content")


@_query("SELECT * FROM (VALUES (0, 'A', 'x', '18446744073709551615'), (1, '', '', NULL)) AS t(seq, sender, content, id)")
def src_rows(spark: SparkSession, d: str) -> DataFrame:
    return from_rows(spark, [{"sender": "A", "content": "x", "id": 2**64 - 1}, {}]).select("seq", "sender", "content", F.col("id").cast("string").alias("id"))


def _instagram_documents(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "instagram_raw")
    share = F.when(F.col("share").isNull(), "null").otherwise(_object(link=_json("share.link"), share_text=_json("share.share_text")))
    return _bundled(t, "rec_id", _object(sender_name=_json(F.coalesce("sender_name", F.lit(""))), timestamp_ms=_json(F.coalesce("timestamp_ms", F.lit(0))), content=_json("content"), share=share))


_FIXED = "CASE WHEN {0} IS NULL THEN NULL WHEN NOT regexp_matches({0}, '[^\\x00-\\x7F]') THEN {0} ELSE coalesce(TRY(decode(unhex(list_aggregate(list_transform(string_split({0}, ''), lambda c: printf('%02x', ord(c) & 255)), 'string_agg', '')))), {0}) END"
_IG = f"""SELECT chat_id, {{0}} AS seq, {_FIXED.format('sender_name')} AS sender, {_FIXED.format('c')} AS content, CASE WHEN ms BETWEEN -62135596800000 AND 253402300799999 THEN ms * 1000 END AS timestamp_us
FROM (SELECT {_PLACE.format('rec_id')}, COUNT(*) OVER (PARTITION BY floor(rec_id / {PER_DOCUMENT})) AS n, coalesce(sender_name, '') AS sender_name, coalesce(timestamp_ms, 0) AS ms, coalesce(content, share.share_text) AS c FROM instagram_raw) WHERE c IS NOT NULL AND {_SOLID.format('c')}"""
_FIVE = ["chat_id", "seq", "sender", "content", "timestamp_us"]


@_query(_IG.replace("{0}", "n - 1 - seq"))
def src_instagram_documents(spark: SparkSession, d: str) -> DataFrame:
    """The newest message comes first in a document and last out of it; bytes are repaired."""
    return _ids(S.parse_instagram(_instagram_documents(spark, d))).select(*_FIVE)


@_query(_IG.replace("{0}", "seq"))
def src_instagram_stream(spark: SparkSession, d: str) -> DataFrame:
    return _ids(S.parse_instagram(_instagram_documents(spark, d), profile="streaming")).select(*_FIVE)


def _discord(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    t = read_table(spark, d, "discord_raw").where("id IS NOT NULL AND timestamp IS NOT NULL AND content IS NOT NULL AND author.name IS NOT NULL")
    named = lambda c, f: F.coalesce(F.to_json(F.transform(F.filter(F.col(c), lambda x: x[f].isNotNull()), lambda x: F.struct(x[f].alias(f)))), F.lit("null"))
    record = _object(
        id=_json("id"), timestamp=_json("timestamp"), timestampEdited=_json("timestamp_edited"), content=_json("content"), author=_object(name=_json("author.name"), nickname=_json("author.nickname")),
        reference=F.when(F.col("reference").isNull(), "null").otherwise(_object(messageId=_json("reference.messageId"))), attachments=named("attachments", "fileName"), stickers=named("stickers", "name"),
    )
    return t, record


_ITEMS = "len(list_filter(coalesce(attachments, []), lambda a: a.fileName IS NOT NULL)) + len(list_filter(coalesce(stickers, []), lambda a: a.name IS NOT NULL))"
_DC = f"""SELECT {{0}} FROM (SELECT {_PLACE.format('rec_id')}, coalesce(author.nickname, author.name) AS sender, {_LINES} AS content, {_RFC.format('timestamp')} AS timestamp_us, {_U64.format('id')} AS id,
{_U64.format('reference.messageId')} AS reply_to, {_RFC.format('timestamp_edited')} AS edited_us, content AS own, {_ITEMS} AS items FROM discord_raw WHERE id IS NOT NULL AND timestamp IS NOT NULL AND content IS NOT NULL AND author.name IS NOT NULL) WHERE {_SOLID.format('own')}{{1}}"""
_EIGHT = "chat_id, seq, sender, content, timestamp_us, id, reply_to, edited_us"


@_query(_DC.replace("{0}", _EIGHT).replace("{1}", " OR items > 0"))
def src_discord_documents(spark: SparkSession, d: str) -> DataFrame:
    return _ids(S.parse_discord(_bundled(*(lambda t, r: (t, "rec_id", r))(*_discord(spark, d)))))


@_query(_DC.replace("{0}", "chat_id, seq, sender, own AS content, timestamp_us, id, edited_us").replace("{1}", ""))
def src_discord_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """A record per line; attachments, stickers and replies are left out."""
    t, record = _discord(spark, d)
    return _ids(S.parse_discord_jsonl(_bundled(t, "rec_id", record, "", "\n", ""))).drop("reply_to")


_TEXT_ROWS = f"""SELECT *, {_PLACE.format('row_id')} FROM (SELECT row_id, sender, replace(content, chr(13) || chr(10), chr(10)) AS content, epoch_us(timestamp) // 60000000 * 60000000 AS timestamp_us FROM messages
WHERE content IS NOT NULL AND timestamp IS NOT NULL AND timestamp > TIMESTAMPTZ '2001-01-01 00:00:00+00' AND timestamp < TIMESTAMPTZ '2060-01-01 00:00:00+00' AND regexp_full_match(sender, '[^\\s:,"](?:[^:\\n\\r]*[^\\s:\\n\\r,"])?'))"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    ok = r"""content IS NOT NULL AND timestamp > TIMESTAMP '2001-01-01 00:00:00Z' AND timestamp < TIMESTAMP '2060-01-01 00:00:00Z' AND regexp_like(sender, '\\A[^\\s:,"](?:[^:\\n\\r]*[^\\s:\\n\\r,"])?\\z')"""
    return read_table(spark, d, "messages").where(ok)


_TRIMMED = "regexp_replace({0}, '^" + _WHITE + "|" + _WHITE + "$', '', 'g')"
_TXT = f"SELECT chat_id, seq + 1 AS seq, sender, {_TRIMMED.replace('{0}', 'c')} AS content, timestamp_us FROM (SELECT *, content || CASE WHEN row_id % 3 = 0 THEN chr(10) || '[Attachment: ' || row_id || '.png]' || chr(10) || '[Sticker: Wave]' ELSE '' END AS c FROM ({_TEXT_ROWS})) WHERE {_SOLID.format('c')}"


def _discord_text(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.when(F.col("row_id") % 2 == 0, F.date_format("timestamp", "M/d/yyyy h:mm a")).otherwise(F.date_format("timestamp", "M/d/yyyy HH:mm:'00'"))
    section = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("\n{Attachments}\nhttps://cdn.example/x/"), "row_id", F.lit(".png\n\n{Stickers}\nWave"))).otherwise("")
    return _bundled(_texts(spark, d), "row_id", F.concat(F.lit("["), stamp, F.lit("] "), "sender", F.lit("\n"), "content", section), "=====\nGuild: x\n", "\n", "\n")


@_query(_TXT)
def src_discord_txt_documents(spark: SparkSession, d: str) -> DataFrame:
    """Two forms of stamps, sections in every third message."""
    return _ids(S.parse_discord_txt(_discord_text(spark, d))).select(*_FIVE)


_CSV = f"SELECT chat_id, seq, sender, content || CASE WHEN row_id % 3 = 0 THEN CASE WHEN content = '' THEN '' ELSE chr(10) END || '[Attachment: ' || row_id || '.png]' || chr(10) || '[Attachment: b c]' ELSE '' END AS content, timestamp_us FROM (SELECT * REPLACE (raw AS content) FROM (SELECT t.*, m.content AS raw FROM ({_TEXT_ROWS}) t JOIN messages m USING (row_id))) WHERE {_SOLID.format('content')} OR row_id % 3 = 0"


def _discord_rows(spark: SparkSession, d: str) -> DataFrame:
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    files = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("https://cdn.example/x/"), "row_id", F.lit(".png, ,b c,"))).otherwise("")
    record = F.concat_ws(",", F.lit('"1"'), q(F.col("sender")), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:'00Z'"), q(F.col("content")), q(files), F.lit('""'))
    return _bundled(_texts(spark, d), "row_id", record, "AuthorID,Author,Date,Content,Attachments,Reactions\n", "\n", "\n")


@_query(_CSV)
def src_discord_csv_documents(spark: SparkSession, d: str) -> DataFrame:
    return _ids(S.parse_discord_csv(_discord_rows(spark, d))).select(*_FIVE)


@_query(f"SELECT 'x.json' AS path, {', '.join(_FIVE)} FROM ({_DC.replace('{0}', _EIGHT).replace('{1}', ' OR items > 0')}) UNION ALL SELECT 'x.TXT', {', '.join(_FIVE)} FROM ({_TXT}) UNION ALL SELECT 'y.csv', {', '.join(_FIVE)} FROM ({_CSV})")
def src_discord_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Documents of all three forms in one table, told apart by their paths."""
    t, record = _discord(spark, d)
    docs = [(_bundled(t, "rec_id", record), "x.json"), (_discord_text(spark, d), "x.TXT"), (_discord_rows(spark, d), "y.csv")]
    every = [x.select(F.concat("chat_id", F.lit("|"), F.lit(p)).alias("chat_id"), "raw", F.lit(p).alias("path")) for x, p in docs]
    m = _ids(S.parse_discord(every[0].unionByName(every[1]).unionByName(every[2])))
    at = F.split("chat_id", r"\|")
    return m.select(at[1].alias("path"), at[0].alias("chat_id"), *_FIVE[1:])


def _whatsapp_text(spark: SparkSession, d: str) -> DataFrame:
    """The format changes with the document; all of them but the one that loses every tie."""
    form = F.floor(F.col("row_id") / PER_DOCUMENT) % 4
    stamp = lambda p: F.date_format("timestamp", p)
    head = (
        F.when(form == 0, F.concat(F.lit("["), stamp("M/d/yy, h:mm a"), F.lit("] "))).when(form == 1, F.concat(F.lit("["), stamp("dd.MM.yy, HH:mm:'00'"), F.lit("] ")))
        .when(form == 2, stamp("dd.MM.yyyy, HH:mm' - '")).otherwise(stamp("dd/MM/yyyy, HH:mm' - '"))
    )
    return _bundled(_texts(spark, d), "row_id", F.concat(head, "sender", F.lit(": "), "content"), "lost line\n", "\n", "\n")


_ROWS = f"SELECT *, string_split(content, chr(10))[1] AS first, list_filter(string_split(content, chr(10))[2:], lambda x: {_SOLID.format('x')}) AS rest, {{0}} AS notice FROM ({_TEXT_ROWS})"
_WHO = "(contains(lower(sender), 'whatsapp') OR contains(lower(sender), 'system'))"


@_query(
    f"""SELECT chat_id, MIN(seq) AS seq, ARG_MIN(sender, seq) AS sender, STRING_AGG(piece, chr(10) ORDER BY seq) AS content, ARG_MIN(timestamp_us, seq) AS timestamp_us FROM (SELECT *, SUM(CASE WHEN notice THEN 0 ELSE 1 END) OVER (PARTITION BY chat_id ORDER BY seq) AS g,
CASE WHEN notice THEN CASE WHEN len(rest) > 0 THEN array_to_string(rest, chr(10)) END ELSE array_to_string(list_concat([first], rest), chr(10)) END AS piece FROM ({_ROWS.replace('{0}', _NOTICE.format(c="string_split(content, chr(10))[1]") + ' OR ' + _WHO)})) WHERE g > 0 GROUP BY chat_id, g"""
)
def src_whatsapp_documents(spark: SparkSession, d: str) -> DataFrame:
    """Notices fall away by their first line, what follows them stays with the message before. Places are those of the
    messages that the document was made of, found again by their order."""
    return _placed(spark, d, S.parse_whatsapp(_whatsapp_text(spark, d)))


def _placed(spark: SparkSession, d: str, m: DataFrame) -> DataFrame:
    return m.select("chat_id", F.col("seq"), "sender", "content", F.unix_micros("timestamp").alias("timestamp_us")).withColumn("seq", F.row_number().over(W.partitionBy("chat_id").orderBy("seq")))


ORACLE_SQL["src_whatsapp_documents"] = f"SELECT * REPLACE (ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY seq) AS seq) FROM ({ORACLE_SQL['src_whatsapp_documents']})"
_STREAMED = f"SELECT *, {_TRIMMED.replace('{0}', 'whole')} AS text FROM (SELECT *, array_to_string(list_concat([first], list_transform(rest, lambda x: regexp_replace(x, '{_WHITE}$', ''))), chr(10)) AS whole FROM ({_ROWS.replace('{0}', 'false')}))"


@_query(f"SELECT chat_id, ROW_NUMBER() OVER (PARTITION BY chat_id ORDER BY seq) AS seq, sender, text AS content, timestamp_us FROM ({_STREAMED}) WHERE {_SOLID.format('text')} AND NOT ({_NOTICE.format(c='text')} OR {_WHO})")
def src_whatsapp_stream_documents(spark: SparkSession, d: str) -> DataFrame:
    """Record-wise: notices are told by their whole text and take what follows them along."""
    return _placed(spark, d, S.parse_whatsapp(_whatsapp_text(spark, d), profile="streaming"))


@_query(ORACLE_SQL["src_whatsapp_documents"])
def src_whatsapp_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same documents as numbered lines, the way those too large for a row are read."""
    return _placed(spark, d, S.parse_whatsapp_lines(S._lines(_whatsapp_text(spark, d))))


# ---- more functions, strings ----------------------------------------------------------------------------------------


@_query("SELECT rec_id, array_to_string(list_transform(list_filter(list_transform(string_split(array_to_string(list_transform(attachments, lambda a: a.url), ','), ','), lambda u: trim(u)), lambda u: u <> ''), lambda u: string_split(u, '/')[-1]), '|') AS names FROM discord_raw WHERE attachments IS NOT NULL")
def x_url_names(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "discord_raw").where(F.col("attachments").isNotNull())
    return t.select("rec_id", F.array_join(X.url_names(F.array_join(F.transform("attachments", lambda a: a["url"]), ",")), "|").alias("names"))


@_query(f"SELECT row_id, (timestamp IS NOT NULL OR id IS NOT NULL OR reply_to IS NOT NULL OR edited IS NOT NULL) AS has_metadata, NOT coalesce({_SOLID.format('content')}, false) AS is_empty FROM messages")
def x_predicates(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "messages").select("row_id", has_metadata().alias("has_metadata"), is_empty().alias("is_empty"))


@_query(f"SELECT row_id, {_MSG.replace('chat_id, seq, ', '')} FROM messages")
def x_model_json(spark: SparkSession, d: str) -> DataFrame:
    """Written as model JSON and read again."""
    m = read_table(spark, d, "messages").withColumn("seq", F.col("row_id"))
    return _ids(from_model_json(to_model_json(m)).withColumnRenamed("seq", "row_id").drop("chat_id"))


def _string(spark: SparkSession, pieces: Iterable[str]) -> DataFrame:
    """The digest and length of a string on the driver, which as a row may be larger than what a task can be sent."""
    digest, n = hashlib.md5(usedforsecurity=False), 0
    for x in pieces:
        digest.update(x.encode())
        n += len(x)
    return spark.createDataFrame([(digest.hexdigest(), n)], "md5 string, n bigint")


_LINE = _Q.format("sender") + " || ';' || " + _Q.format("content")


@_query(f"SELECT md5(t) AS md5, CAST(length(t) AS BIGINT) AS n FROM (SELECT 'Sender;Content' || chr(10) || STRING_AGG({_LINE} || chr(10), '' ORDER BY chat_id, seq) AS t FROM {_EVENTS})")
def k_csv_string(spark: SparkSession, d: str) -> DataFrame:
    return _string(spark, K.format_pieces(_events(spark, d), "csv"))


_ONE = "'{{\"sender\":' || CAST(to_json(sender) AS VARCHAR) || ',\"content\":' || CAST(to_json(content) AS VARCHAR) || '}}'"


@_query("SELECT md5(t) AS md5, CAST(length(t) AS BIGINT) AS n FROM (SELECT STRING_AGG(" + _ONE.replace("{{", "{").replace("}}", "}") + f" || chr(10), '' ORDER BY chat_id, seq) AS t FROM {_EVENTS})")
def k_jsonl_string(spark: SparkSession, d: str) -> DataFrame:
    return _string(spark, K.format_pieces(_events(spark, d), "ndjson"))


@_query(
    "SELECT md5(t) AS md5, CAST(length(t) AS BIGINT) AS n FROM (SELECT '[' || chr(10) || STRING_AGG('  {' || chr(10) || '    \"sender\": ' || CAST(to_json(sender) AS VARCHAR) || ',' || chr(10) || '    \"content\": ' || CAST(to_json(content) AS VARCHAR) || chr(10) || '  }', ',' || chr(10) ORDER BY chat_id, seq) || chr(10) || ']' AS t FROM "
    + _EVENTS + ")"
)
def k_json_string(spark: SparkSession, d: str) -> DataFrame:
    return _string(spark, K.format_pieces(_events(spark, d), "json"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Telegram records as messages, filtered, merged and written as CSV lines."""
    t = read_table(spark, d, "telegram_raw")
    r = F.struct(F.col("id").cast("decimal(20,0)").alias("id"), "type", "date_unixtime", F.col("from_name").alias("from"), F.try_parse_json("text").alias("text"), F.col("reply_to_message_id").cast("decimal(20,0)").alias("reply_to_message_id"), "edited_unixtime")
    x = t.select("rec_id", "chat_id", "seq", S.telegram_message(r).alias("m")).where(F.col("m").isNotNull()).select("rec_id", "chat_id", "seq", "m.*")
    once = x.groupBy("chat_id", "seq").agg(F.min_by(F.struct(*MESSAGE_COLUMNS[2:]), "rec_id").alias("m")).select("chat_id", "seq", "m.*")
    return K.csv_lines(M.merge_consecutive(M.apply_filters(once, FilterConfig().with_date_from("2023-01-01"))), ALL)


_FLAG = f"""(SELECT chat_id, seq, ARG_MIN(sender, rec_id) AS sender, ARG_MIN(content, rec_id) AS content, ARG_MIN(struct_pack(t := timestamp_us), rec_id).t AS timestamp_us, ARG_MIN(struct_pack(i := id), rec_id).i AS id,
ARG_MIN(struct_pack(r := reply_to), rec_id).r AS reply_to, ARG_MIN(struct_pack(e := edited_us), rec_id).e AS edited_us FROM ({ORACLE_SQL["src_telegram"]}) GROUP BY chat_id, seq HAVING ARG_MIN(struct_pack(t := timestamp_us), rec_id).t >= 1672531200000000)"""
_RUNS = _MERGE.replace("ARG_MIN(struct_pack(i := id), seq).i AS id", "ARG_MIN(struct_pack(i := id), seq).i AS id, ARG_MIN(struct_pack(r := reply_to), seq).r AS reply_to, ARG_MIN(struct_pack(e := edited_us), seq).e AS edited_us")
_US = "coalesce(strftime(make_timestamp({}), '%Y-%m-%d %H:%M:%S'), '')"
QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = (
    f"SELECT chat_id, seq, coalesce(id, '') || ';' || {_US.format('timestamp_us')} || ';' || {_Q.format('sender')} || ';' || {_Q.format('content')} || ';' || coalesce(reply_to, '') || ';' || {_US.format('edited_us')} AS line FROM {_RUNS.format(_FLAG)}"
)
