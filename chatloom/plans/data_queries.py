"""The queries of problems 1, 4, 5 and 7 over the chat-export tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators import dedup, flatten, instants, sessions
from chatloom.session import read_table


def _raws(spark: SparkSession, d: str) -> list[DataFrame]:
    return [read_table(spark, d, f"{p}_raw") for p in ("telegram", "discord", "instagram")]


def p1_instants(spark: SparkSession, d: str) -> DataFrame:
    return instants.raw_instants(*_raws(spark, d), read_table(spark, d, "chats"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.stamp_mismatches(p1_instants(spark, d), read_table(spark, d, "messages"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "discord_raw").withColumn("id_number", dedup.number_id(F.col("id")))


def p4_messages(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("batch_no"), F.col("received_at"), F.col("row_id")]
    m = dedup.deduplicate(read_table(spark, d, "messages"), ["chat_id", "id"], order)
    return m.select("row_id", "chat_id", "seq", "sender", "content", F.unix_micros("timestamp").alias("timestamp_us"), F.col("id").cast("string").alias("id"), "batch_no")


def p4_discord(spark: SparkSession, d: str) -> DataFrame:
    kept = dedup.deduplicate(_numbered(spark, d), ["chat_id", "id_number"], [F.col("batch_no"), F.col("rec_id")])
    return kept.select("rec_id", "chat_id", "seq", F.col("id_number").cast("string").alias("id_number"), "content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys of the rows that were kept one of several of."""
    order = [F.col("batch_no"), F.col("received_at"), F.col("row_id")]
    m = dedup.deduplicate(read_table(spark, d, "messages"), ["chat_id", "id"], order, mark="copies")
    r = dedup.deduplicate(_numbered(spark, d).drop("id"), ["chat_id", "id_number"], [F.col("batch_no"), F.col("rec_id")], mark="copies").withColumnRenamed("id_number", "id")
    pick = lambda src, x: x.where(F.col("copies") > 1).select(F.lit(src).alias("src"), "chat_id", F.col("id").cast("decimal(20,0)").cast("string").alias("id"))
    return pick("messages", m).unionByName(pick("discord_raw", r))


def p4_incremental(spark: SparkSession, d: str) -> DataFrame:
    """What the deliveries after the twentieth batch add to the messages kept from the first twenty."""
    m = read_table(spark, d, "messages")
    order = [F.col("batch_no"), F.col("received_at"), F.col("row_id")]
    stored = dedup.deduplicate(m.where(F.col("batch_no") <= 20), ["chat_id", "id"], order)
    new = dedup.deduplicate(m.where(F.col("batch_no") > 20), ["chat_id", "id"], order, stored=stored)
    return new.select("row_id", "chat_id", "seq", F.col("id").cast("string").alias("id"), "batch_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.nested_nodes(*_raws(spark, d)).select("src", "rec_id", "path")


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its label, its parent and its table."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ".")
    return flatten.nested_nodes(*_raws(spark, d)).withColumns({"label": text("label"), "parent_label": text("parent_label")})


def _labels(df: DataFrame) -> DataFrame:
    """Labels as text, which every engine compares alike."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ".") for c in ("label", "parent_label", "dewey") if c in df.columns})


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    return _labels(flatten.telegram_text_table(read_table(spark, d, "telegram_raw")))


def p5_authors(spark: SparkSession, d: str) -> DataFrame:
    return _labels(flatten.discord_author_table(read_table(spark, d, "discord_raw")))


def p5_roles(spark: SparkSession, d: str) -> DataFrame:
    return _labels(flatten.discord_role_table(read_table(spark, d, "discord_raw")))


def p5_attachments(spark: SparkSession, d: str) -> DataFrame:
    return _labels(flatten.discord_attachment_table(read_table(spark, d, "discord_raw")))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return _labels(flatten.instagram_share_table(read_table(spark, d, "instagram_raw")))


def _sent(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "messages").where(~sessions.is_blank(F.col("sender")))


def p7_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(_sent(spark, d), ["chat_id", "sender"], "timestamp", event="seq")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(_sent(spark, d), ["chat_id", "sender"], "timestamp").select("chat_id", "sender", "start_us", "end_us")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_instants, p4_found, p4_messages, p4_discord, p4_incremental, p5_found, p5_nodes, p5_text, p5_authors, p5_roles, p5_attachments, p5_shares,
        p7_found, p7_sessions,
    )
}


_NUMBER = "CASE WHEN regexp_full_match({0}, '\\+?[0-9]+') THEN TRY_CAST({0} AS HUGEINT) END"
_CHILD = "SELECT rec_id, unnest(range(len({0}))) AS i, unnest({0}) AS e FROM discord_raw{1}"
_TEXT = """WITH RECURSIVE n(rec_id, path, dewey, e) AS (
SELECT rec_id, 'text[' || i || ']', [7, i], e FROM (SELECT rec_id, unnest(range(len(a))) AS i, unnest(a) AS e FROM (SELECT rec_id, CAST(CAST(text AS JSON) AS JSON[]) AS a FROM telegram_raw WHERE json_valid(text) AND json_type(text) = 'ARRAY'))
UNION ALL
SELECT rec_id, path || '.text[' || i || ']', list_concat(dewey, [0, i]), e FROM (SELECT rec_id, path, dewey, unnest(range(len(a))) AS i, unnest(a) AS e FROM (SELECT rec_id, path, dewey, CAST(e -> '$.text' AS JSON[]) AS a FROM n WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.text') = 'ARRAY')))
"""
_SESSIONS = """SELECT chat_id, sender, MIN(us) AS start_us, MAX(us) AS end_us, COUNT(*) AS n FROM (
SELECT *, SUM(cut) OVER (PARTITION BY chat_id, sender ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS k FROM (
SELECT *, CASE WHEN us - LAG(us) OVER (PARTITION BY chat_id, sender ORDER BY us, seq) <= 1800000000 THEN 0 ELSE 1 END AS cut FROM (
SELECT DISTINCT chat_id, sender, seq, epoch_us(timestamp) AS us FROM messages WHERE timestamp IS NOT NULL AND chat_id IS NOT NULL AND trim(sender) <> ''))) GROUP BY chat_id, sender, k"""

ORACLE_SQL = {
    "p4_found": f"""SELECT 'messages' AS src, chat_id, CAST(id AS VARCHAR) AS id FROM messages WHERE id IS NOT NULL GROUP BY chat_id, id HAVING COUNT(*) > 1
UNION ALL SELECT 'discord_raw' AS src, chat_id, CAST(n AS VARCHAR) AS id FROM (SELECT chat_id, {_NUMBER.format("id")} AS n FROM discord_raw) WHERE n IS NOT NULL GROUP BY chat_id, n HAVING COUNT(*) > 1""",
    "p4_discord": f"""SELECT rec_id, chat_id, seq, n AS id_number, content FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id, n ORDER BY batch_no, rec_id) AS k FROM (SELECT *, {_NUMBER.format("id")} AS n FROM discord_raw)) WHERE n IS NULL OR k = 1""".replace("n AS id_number", "CAST(n AS VARCHAR) AS id_number"),
    "p4_messages": "SELECT row_id, chat_id, seq, sender, content, epoch_us(timestamp) AS timestamp_us, CAST(id AS VARCHAR) AS id, batch_no FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id, id ORDER BY batch_no, received_at, row_id) AS k FROM messages) WHERE id IS NULL OR k = 1",
    "p5_found": _TEXT + """SELECT 'telegram_raw' AS src, rec_id, path FROM n WHERE json_type(e) IN ('VARCHAR', 'OBJECT')
UNION ALL SELECT 'discord_raw', rec_id, 'author' FROM discord_raw WHERE author IS NOT NULL
UNION ALL SELECT 'discord_raw', rec_id, 'author.roles[' || i || ']' FROM (""" + _CHILD.format("author.roles", " WHERE author IS NOT NULL") + """) WHERE e IS NOT NULL
UNION ALL SELECT 'discord_raw', rec_id, 'attachments[' || i || ']' FROM (""" + _CHILD.format("attachments", "") + """) WHERE e IS NOT NULL
UNION ALL SELECT 'instagram_raw', rec_id, 'share' FROM instagram_raw WHERE share IS NOT NULL""",
    "p5_text": _TEXT + """SELECT rec_id, path, CASE WHEN len(dewey) > 2 THEN regexp_replace(path, '\\.text\\[[0-9]+\\]$', '') END AS parent_path, CAST(dewey[len(dewey)] AS INTEGER) AS place,
array_to_string(dewey, '.') AS dewey, CASE json_type(e) WHEN 'VARCHAR' THEN 'string' ELSE 'object' END AS kind, CASE WHEN json_type(e, '$.type') = 'VARCHAR' THEN e ->> '$.type' END AS type,
CASE WHEN json_type(e) = 'VARCHAR' THEN e ->> '$' WHEN json_type(e, '$.text') = 'VARCHAR' THEN e ->> '$.text' END AS value, CASE WHEN json_type(e, '$.href') = 'VARCHAR' THEN e ->> '$.href' END AS href
FROM n WHERE json_type(e) IN ('VARCHAR', 'OBJECT')""",
    "p5_nodes": _TEXT + """, c AS (SELECT 'telegram_raw' AS src, rec_id, array_to_string(dewey, '.') AS label, array_to_string(dewey[:-3], '.') AS parent, path FROM n WHERE json_type(e) IN ('VARCHAR', 'OBJECT')
UNION ALL SELECT 'discord_raw', rec_id, '8.0', '', 'author' FROM discord_raw WHERE author IS NOT NULL
UNION ALL SELECT 'discord_raw', rec_id, '8.0.3.' || i, '8.0', 'author.roles[' || i || ']' FROM (""" + _CHILD.format("author.roles", " WHERE author IS NOT NULL") + """) WHERE e IS NOT NULL
UNION ALL SELECT 'discord_raw', rec_id, '10.' || i, '', 'attachments[' || i || ']' FROM (""" + _CHILD.format("attachments", "") + """) WHERE e IS NOT NULL
UNION ALL SELECT 'instagram_raw', rec_id, '6.0', '', 'share' FROM instagram_raw WHERE share IS NOT NULL)
SELECT src, rec_id, regexp_replace(path, '\\[[0-9]+\\]', '', 'g') AS "table", label, nullif(parent, '') AS parent_label, path, CASE WHEN parent <> '' THEN regexp_replace(path, '\\.[^.]*$', '') END AS parent_path FROM c""",
    "p5_authors": "SELECT rec_id, '8.0' AS label, CAST(NULL AS VARCHAR) AS parent_label, 'author' AS path, author.id AS author_id, author.name AS name, author.nickname AS nickname FROM discord_raw WHERE author IS NOT NULL",
    "p5_roles": "SELECT rec_id, '8.0.3.' || i AS label, '8.0' AS parent_label, 'author.roles[' || i || ']' AS path, 'author' AS parent_path, CAST(i AS INTEGER) AS place, e.id AS role_id, e.name AS name FROM (" + _CHILD.format("author.roles", " WHERE author IS NOT NULL") + ") WHERE e IS NOT NULL",
    "p5_attachments": "SELECT rec_id, '10.' || i AS label, CAST(NULL AS VARCHAR) AS parent_label, 'attachments[' || i || ']' AS path, CAST(i AS INTEGER) AS place, e.id AS attachment_id, e.url AS url, e.fileName AS file_name, e.fileSizeBytes AS file_size FROM (" + _CHILD.format("attachments", "") + ") WHERE e IS NOT NULL",
    "p5_shares": "SELECT rec_id, '6.0' AS label, CAST(NULL AS VARCHAR) AS parent_label, 'share' AS path, share.link AS link, share.share_text AS share_text FROM instagram_raw WHERE share IS NOT NULL",
    "p4_incremental": "SELECT row_id, chat_id, seq, CAST(id AS VARCHAR) AS id, batch_no FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY chat_id, id ORDER BY batch_no, received_at, row_id) AS k FROM messages WHERE batch_no > 20) n WHERE id IS NULL OR (k = 1 AND NOT EXISTS (SELECT 1 FROM messages o WHERE o.batch_no <= 20 AND o.chat_id = n.chat_id AND o.id = n.id))",
    "p7_found": f"SELECT chat_id, sender, start_us, end_us FROM ({_SESSIONS})",
    "p7_sessions": f"SELECT chat_id, sender, start_us, end_us, end_us - start_us AS duration_us, n AS n_events FROM ({_SESSIONS})",
}
