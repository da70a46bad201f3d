"""Raw exports as messages: pure functions from DataFrames to DataFrames.

Each parser takes ``chat_id, raw`` (a whole document per row) and returns :data:`MESSAGE_COLUMNS`; ``seq`` is the
place in the document's own order. ``on_error='fail'`` rejects a document with one bad record, ``'skip'`` drops the
record; ``profile='streaming'`` gives the results of record-wise readers where they differ.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.config import CONFIGS, DiscordConfig, InstagramConfig, Platform, TelegramConfig, WhatsAppConfig
from chatloom.errors import InvalidFormatError
from chatloom.functions import text as X
from chatloom.operators.ordered import running
from chatloom.schema import DISCORD_RECORD, INSTAGRAM_RECORD, MESSAGE_COLUMNS, STRICT, TELEGRAM_RECORD, message

__all__ = [
    "telegram_message", "instagram_message", "discord_message", "parse_telegram", "parse_instagram", "parse_discord_json", "parse_discord_jsonl",
    "parse_discord_txt", "parse_discord_csv", "parse_discord", "parse_whatsapp", "parse_whatsapp_lines", "checked_records", "parse_records", "whatsapp_format", "parse_chat", "PARSERS",
]


# ---- rows -------------------------------------------------------------------------------------------------------


def telegram_message(r: Column) -> Column:
    """Raw record -> message, or null: not of type ``message``, without sender, or without text."""
    content = X.variant_text(r["text"])
    ok = (r["type"] == "message") & r["from"].isNotNull() & r["text"].isNotNull() & X.not_blank(content)
    return F.when(ok, message(r["from"], content, X.unix_seconds(r["date_unixtime"]), r["id"], r["reply_to_message_id"], X.unix_seconds(r["edited_unixtime"])))


def instagram_message(r: Column, fix_encoding: bool = True) -> Column:
    """Raw record -> message, or null without content; a null content is replaced by the share's text."""
    fix = X.low_byte_repair if fix_encoding else (lambda c: c)
    content = F.coalesce(r["content"], r["share"]["share_text"])
    return F.when(X.not_blank(content), message(fix(r["sender_name"]), fix(content), X.unix_millis(r["timestamp_ms"])))


def discord_message(r: Column, config: DiscordConfig = DiscordConfig(), stream: str | None = None) -> Column:
    """Raw record -> message, or null without content, attachments and stickers.

    *stream* ``json`` ignores attachments and stickers, ``jsonl`` the reply, too.
    """
    none = F.array().cast("array<string>")
    lists = config.include_attachments and stream is None
    files = F.coalesce(F.transform(r["attachments"], lambda a: a["fileName"]), none) if lists else none
    stickers = F.coalesce(F.transform(r["stickers"], lambda s: s["name"]), none) if lists else none
    content = X.append_lines(r["content"], X.attachment_lines(files), X.sticker_lines(stickers)) if lists else r["content"]
    name = F.coalesce(r["author"]["nickname"], r["author"]["name"]) if config.prefer_nickname else r["author"]["name"]
    reply = F.lit(None).cast("string") if stream == "jsonl" else r["reference"]["messageId"]
    ok = X.not_blank(r["content"]) | (F.size(files) > 0) | (F.size(stickers) > 0)
    return F.when(ok, message(name, content, X.rfc3339(r["timestamp"]), X.u64(r["id"]), X.u64(reply), X.rfc3339(r["timestampEdited"])))


def _strict(platform: str) -> tuple:
    """The schema under which a record's checked fields keep their JSON types, and a function from such a record to
    whether it is well-formed and to the record itself. Where a reader coerces numbers to text, records with them would
    pass; so the types are looked at."""
    fields = {"Telegram": TELEGRAM_RECORD, "Instagram": INSTAGRAM_RECORD, "Discord": DISCORD_RECORD}[platform]
    kinds = STRICT[platform]
    schema = fields
    for name in {k.rsplit(".", 1)[-1] for k in kinds}:
        schema = re.sub(rf"(?<![A-Za-z_])(`?{name}`?: )(?:STRING|BIGINT|DECIMAL\(20,0\))", r"\1VARIANT", schema)
    # Fields of a checked name elsewhere keep their type: the arrays' own names and addresses.
    schema = re.sub(r"(ARRAY<STRUCT<\w+: )VARIANT", r"\1STRING", schema)

    def get(r: Column, path: str) -> Column:
        for part in path.split("."):
            r = r[part]
        return r

    def check(r: Column) -> Column:
        tests = []
        for path, allowed in kinds.items():
            v = get(r, path)
            kind = F.schema_of_variant(v)
            good = kind.isin(sorted(allowed)) | (kind.rlike(r"^DECIMAL\(\d+,0\)$") if "BIGINT" in allowed else F.lit(False))
            if path in ("id", "reply_to_message_id") and platform == "Telegram":
                good = good & ~F.coalesce(F.try_variant_get(v, "$", "decimal(38,0)") < 0, F.lit(False))
            absent = v.isNull() & F.lit("VOID" in allowed)
            tests.append(absent | F.coalesce(good, F.lit(False)))
        return reduce(lambda x, y: x & y, tests)

    def value(r: Column, path: str, kind: str) -> Column:
        return F.try_variant_get(get(r, path), "$", kind).alias(path.rsplit(".", 1)[-1])

    def plain(r: Column) -> Column:
        if platform == "Telegram":
            numbers = {"id", "reply_to_message_id"}
            return F.struct(*[value(r, k, "decimal(20,0)" if k in numbers else "string") for k in kinds], r["text"].alias("text"))
        if platform == "Instagram":
            share = F.struct(value(r, "share.share_text", "string"), value(r, "share.link", "string")).alias("share")
            return F.struct(value(r, "sender_name", "string"), value(r, "timestamp_ms", "bigint"), value(r, "content", "string"), share)
        author = F.struct(value(r, "author.name", "string"), value(r, "author.nickname", "string")).alias("author")
        own = [value(r, k, "string") for k in ("id", "timestamp", "timestampEdited", "content")]
        return F.struct(*own, author, F.struct(value(r, "reference.messageId", "string")).alias("reference"), r["attachments"].alias("attachments"), r["stickers"].alias("stickers"))

    return schema, check, plain


_STRICT = {k: _strict(k) for k in STRICT}


def _malformed(platform: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{platform}: a malformed record in "), "chat_id"))


# What a document must look like somewhere for a field of it to have a wrong JSON type: a name and behind it a value of
# another kind. (It may stand in a text or deeper down; the records then tell.)
_SUSPECT = {
    "Telegram": r'"(?:type|from|date_unixtime|edited_unixtime)"\s*:\s*[^"\sn]|"(?:id|reply_to_message_id)"\s*:\s*(?:[^0-9\sn]|[0-9]+[.eE])',
    "Instagram": r'"(?:sender_name|content|share_text|link)"\s*:\s*[^"\sn]|"timestamp_ms"\s*:\s*(?:[^0-9\s-]|-?[0-9]+[.eE])',
    "Discord": r'"(?:id|timestamp|timestampEdited|content|name|nickname|messageId)"\s*:\s*[^"\sn]',
}
_PLAIN = {"Telegram": TELEGRAM_RECORD, "Instagram": INSTAGRAM_RECORD, "Discord": DISCORD_RECORD}
# Fields without which a record of text where text must be is malformed.
_REQUIRED = {
    "Telegram": lambda r: r["type"].isNotNull(),
    "Instagram": lambda r: r["sender_name"].isNotNull() & r["timestamp_ms"].isNotNull(),
    "Discord": lambda r: r["id"].isNotNull() & r["timestamp"].isNotNull() & r["content"].isNotNull() & r["author"]["name"].isNotNull(),
}


def _same_fields(platform: str, r: Column) -> Column:
    """A record with the fields that a checked one has, in their order."""
    if platform == "Telegram":
        return F.struct(*[r[k].alias(k) for k in [*STRICT[platform], "text"]])
    if platform == "Instagram":
        share = F.struct(r["share"]["share_text"].alias("share_text"), r["share"]["link"].alias("link")).alias("share")
        return F.struct(*[r[k].alias(k) for k in ("sender_name", "timestamp_ms", "content")], share)
    author = F.struct(r["author"]["name"].alias("name"), r["author"]["nickname"].alias("nickname")).alias("author")
    reference = F.struct(r["reference"]["messageId"].alias("messageId")).alias("reference")
    return F.struct(*[r[k].alias(k) for k in ("id", "timestamp", "timestampEdited", "content")], author, reference, r["attachments"].alias("attachments"), r["stickers"].alias("stickers"))


def _records(df: DataFrame, platform: str, on_error: str, largest: int | None = None) -> DataFrame:
    """``chat_id, pos, n, r``: the elements of ``messages``.

    Documents in which some value could be of a wrong type have the types of all their records looked at; the others,
    which one pass of a pattern tells, are read straight to their fields.
    """
    suspect = F.coalesce(F.col("raw").rlike(_SUSPECT[platform]), F.lit(False))
    plain = _elements(df.where(~suspect), platform, _PLAIN[platform], on_error, largest)
    if on_error == "skip":
        plain = plain.withColumn("r", F.from_json("r", _PLAIN[platform]))
    whole = F.col("r").isNotNull() & F.coalesce(_REQUIRED[platform](F.col("r")), F.lit(False))
    if on_error == "fail":
        plain = plain.withColumn("r", F.when(whole, _same_fields(platform, F.col("r"))).otherwise(_malformed(platform)))
    else:
        plain = plain.where(whole).withColumn("r", _same_fields(platform, F.col("r")))
    strict = checked_records(_elements(df.where(suspect), platform, _STRICT[platform][0], on_error, largest), platform, on_error)
    return plain.unionByName(strict)


def _elements(df: DataFrame, platform: str, schema: str, on_error: str, largest: int | None) -> DataFrame:
    """To fail, the document is parsed once, as a whole. To skip, it is parsed to the texts of its elements and each of
    them on its own, so one bad record hurts no other and its size can be limited."""
    fail = on_error == "fail"
    d = df.select("chat_id", F.from_json("raw", f"messages ARRAY<{schema if fail else 'STRING'}>")["messages"].alias("items"))
    if fail:
        bad = F.raise_error(F.concat(F.lit(f"{platform}: no valid document with messages in "), "chat_id"))
        d = d.withColumn("items", F.when(F.col("items").isNotNull(), F.col("items")).otherwise(bad))
    # The outer form, as Spark would move a test of what the inner one explodes in front of other filters. The size is
    # taken before: after it, every element's row would carry the whole array.
    d = d.withColumn("n", F.size("items")).select("chat_id", "n", F.posexplode_outer("items").alias("pos", "r")).where(F.col("pos").isNotNull())
    return d.where(F.octet_length("r") <= largest) if largest is not None and not fail else d


def checked_records(d: DataFrame, platform: str, on_error: str) -> DataFrame:
    """Records as structs; in ``skip`` they come as JSON texts."""
    schema, check, plain = _STRICT[platform]
    if on_error == "skip":
        d = d.withColumn("r", F.from_json("r", schema))
    whole = F.col("r").isNotNull() & F.coalesce(check(F.col("r")), F.lit(False))
    if on_error == "fail":
        return d.withColumn("r", F.when(whole, plain(F.col("r"))).otherwise(_malformed(platform)))
    return d.where(whole).withColumn("r", plain(F.col("r")))


def _messages(d: DataFrame, m: Column, seq: Column) -> DataFrame:
    return d.select("chat_id", seq.cast("bigint").alias("seq"), m.alias("m")).where(F.col("m").isNotNull()).select("chat_id", "seq", "m.*")


def _policy(on_error: str | None, profile: str) -> str:
    return on_error or ("skip" if profile == "streaming" else "fail")


def parse_records(records: DataFrame, platform: Platform | str, config=None, on_error: str = "skip", profile: str = "eager") -> DataFrame:
    """Messages of ``chat_id, pos, item``: records as JSON texts, as :mod:`chatloom.sources.json_array` reads them from
    documents of any size. Telegram, Instagram (whose later places come first) and Discord."""
    p = Platform.from_name(platform)
    config = config or CONFIGS[p]()
    stream = profile == "streaming"
    d = records.select("chat_id", "pos", F.col("item").alias("r"))
    if on_error == "fail":
        d = d.withColumn("r", F.from_json("r", _STRICT[str(p)][0]))
    d = checked_records(d, str(p), on_error)
    m = {
        Platform.TELEGRAM: lambda r: telegram_message(r), Platform.INSTAGRAM: lambda r: instagram_message(r, stream or config.fix_encoding),
        Platform.DISCORD: lambda r: discord_message(r, config, "json" if stream else None),
    }[p](F.col("r"))
    return _messages(d, m, -1 - F.col("pos") if p is Platform.INSTAGRAM and not stream else F.col("pos"))


# ---- JSON documents ---------------------------------------------------------------------------------------------


def parse_telegram(df: DataFrame, config: TelegramConfig = TelegramConfig(), on_error: str | None = None, profile: str = "eager") -> DataFrame:
    d = _records(df, "Telegram", _policy(on_error, profile), config.max_message_size if profile == "streaming" else None)
    return _messages(d, telegram_message(F.col("r")), F.col("pos"))


def parse_instagram(df: DataFrame, config: InstagramConfig = InstagramConfig(), on_error: str | None = None, profile: str = "eager") -> DataFrame:
    """The export has the newest message first, so places count from its end; the streaming profile keeps file order
    and always repairs the encoding."""
    stream = profile == "streaming"
    d = _records(df, "Instagram", _policy(on_error, profile), config.max_message_size if stream else None)
    return _messages(d, instagram_message(F.col("r"), stream or config.fix_encoding), F.col("pos") if stream else F.col("n") - 1 - F.col("pos"))


def parse_discord_json(df: DataFrame, config: DiscordConfig = DiscordConfig(), on_error: str | None = None, profile: str = "eager") -> DataFrame:
    stream = profile == "streaming"
    d = _records(df, "Discord", _policy(on_error, profile), config.max_message_size if stream else None)
    return _messages(d, discord_message(F.col("r"), config, "json" if stream else None), F.col("pos"))


def parse_discord_jsonl(df: DataFrame, config: DiscordConfig = DiscordConfig(), on_error: str = "skip", profile: str = "streaming") -> DataFrame:
    """A record per line; blank lines are none."""
    d = df.select("chat_id", F.posexplode(X.split_lines(F.col("raw"))).alias("pos", "line")).where(X.not_blank(F.col("line")))
    d = checked_records(d.select("chat_id", "pos", F.when(F.col("line").rlike(r"^\s*\{") & F.try_parse_json("line").isNotNull(), F.col("line")).alias("r")), "Discord", "skip") if on_error == "skip" else checked_records(
        d.select("chat_id", "pos", F.from_json("line", _STRICT["Discord"][0]).alias("r")), "Discord", "fail"
    )
    return _messages(d, discord_message(F.col("r"), config, "jsonl" if profile == "streaming" else None), F.col("pos"))


# ---- lines ------------------------------------------------------------------------------------------------------

# The line grammar of WhatsApp exports in order of preference, with the groups date, time, sender, text.
WHATSAPP_FORMATS = {
    "US": r"(?Ud)^\[(\d{1,2}/\d{1,2}/\d{2,4}),\s(\d{1,2}:\d{2}(?::\d{2})?(?:\s?[APap][Mm])?)\]\s([^:]+):\s?(.*)",
    "EuDotBracketed": r"(?Ud)^\[(\d{2}\.\d{2}\.\d{2,4}),\s(\d{2}:\d{2}(?::\d{2})?)\]\s([^:]+):\s?(.*)",
    "EuDotNoBracket": r"(?Ud)^(\d{2}\.\d{2}\.\d{2,4}),\s(\d{2}:\d{2}(?::\d{2})?)\s-\s([^:]+):\s?(.*)",
    "EuSlash": r"(?Ud)^(\d{2}/\d{2}/\d{2,4}),\s(\d{2}:\d{2}(?::\d{2})?)\s-\s([^:]+):\s?(.*)",
    "EuSlashBracketed": r"(?Ud)^\[(\d{2}/\d{2}/\d{2,4}),\s(\d{2}:\d{2}(?::\d{2})?)\]\s([^:]+):\s?(.*)",
}
# Characters that no text interchanges (Unicode's noncharacters) mark where messages and sections begin.
_MARK, _PART = "\ufdd0", "\ufdd1"
SAMPLE_LINES = 20


def _lines(df: DataFrame) -> DataFrame:
    return df.select("chat_id", F.posexplode(X.split_lines(F.col("raw"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def whatsapp_format(lines: DataFrame, disambiguate_slash: bool = False) -> DataFrame:
    """``chat_id, format``: the format that most of a document's first lines have, the earlier one in a tie, else null."""
    head = lines.where(F.col("line_no") < SAMPLE_LINES)
    votes = [F.count_if(F.col("line").rlike(p)).alias(k) for k, p in WHATSAPP_FORMATS.items()]
    day_first = F.max(F.regexp_extract("line", r"^\[(\d{1,2})/", 1).try_cast("int")) > 12
    d = head.groupBy("chat_id").agg(*votes, F.coalesce(day_first, F.lit(False)).alias("__day"))
    top = F.greatest(*[F.col(k) for k in WHATSAPP_FORMATS])
    pick = reduce(lambda c, k: c.when(F.col(k) == top, k), WHATSAPP_FORMATS, F.when(top == 0, F.lit(None).cast("string")))
    if disambiguate_slash:
        pick = F.when((top > 0) & (F.col("EuSlashBracketed") == top) & F.col("__day"), "EuSlashBracketed").otherwise(pick)
    return d.select("chat_id", pick.alias("format"))


def _by_format(f) -> Column:
    return reduce(lambda c, k: c.when(F.col("format") == k, f(WHATSAPP_FORMATS[k])), WHATSAPP_FORMATS, F.when(F.lit(False), f(WHATSAPP_FORMATS["US"])))


def _whatsapp_stamp(date: Column, time: Column, form: Column) -> Column:
    d, t = F.split(date, r"[./]"), F.split(F.regexp_replace(time, r"(?U)\s?[AaPp][Mm]$", ""), ":")
    a, b, y = (d[i].try_cast("int") for i in range(3))
    half = F.lower(F.regexp_extract(time, r"([AaPp])[Mm]$", 1))
    month_first = form == "US"
    short = F.length(d[2]) == 2
    known = short | (F.length(d[2]) == 4)
    sec = F.coalesce(F.try_element_at(t, F.lit(3)).try_cast("int"), F.lit(0))
    stamp = X.local_stamp(y, F.when(month_first, a).otherwise(b), F.when(month_first, b).otherwise(a), t[0].try_cast("int"), t[1].try_cast("int"), sec, half, short)
    return F.when(known, stamp)


def _unix_lines(raw: Column) -> Column:
    return F.when(raw.contains("\r\n"), F.replace(raw, F.lit("\r\n"), F.lit("\n"))).otherwise(raw)


def _first_line(piece: Column) -> Column:
    return F.substring_index(piece, "\n", 1)


def _other_lines(piece: Column) -> Column:
    """What follows the first line, with the line end before it."""
    return F.when(piece.contains("\n"), piece.substr(F.length(_first_line(piece)) + 1, F.length(piece)))


def parse_whatsapp(df: DataFrame, config: WhatsAppConfig = WhatsAppConfig(), on_error: str | None = None, profile: str = "eager") -> DataFrame:
    """Header lines open messages, other lines continue the last one kept; see the profiles' differences.

    Eager: notices are told by the header line and skipped, after which lines go on with the earlier message; blank
    contents stay. Streaming: lines after a notice go with it, notices are told by the whole text, contents are
    trimmed and blank ones dropped. A document in which no line has a known format fails (or, skipped, has no messages).
    """
    return parse_whatsapp_lines(_lines(df), config, on_error, profile)


def parse_whatsapp_lines(lines: DataFrame, config: WhatsAppConfig = WhatsAppConfig(), on_error: str | None = None, profile: str = "eager") -> DataFrame:
    """:func:`parse_whatsapp` of documents too large for a row, as ``chat_id, line_no, line``: lines are numbered and folded
    across tasks, in buckets of places; the same messages, with the header's line number as ``seq``."""
    stream = profile == "streaming"
    formats = whatsapp_format(lines, config.disambiguate_slash)
    if _policy(on_error, profile) == "fail":
        bad = F.raise_error(F.concat(F.lit("WhatsApp: unknown format of the export "), "chat_id"))
        formats = formats.withColumn("format", F.when(F.col("format").isNotNull(), F.col("format")).otherwise(bad.cast("string")))
    d = lines.join(formats, "chat_id").where(X.not_blank(F.col("line")) & F.col("format").isNotNull())
    # One replacement gives all parts of a header line, marked; other lines stay as they are.
    d = d.withColumn("h", _by_format(lambda p: F.regexp_replace("line", p + "$", "\u0001$1\u0001$2\u0001$3\u0001$4")))
    d = d.withColumn("h", F.when(F.col("h").startswith("\u0001"), F.slice(F.split("h", "\u0001"), 2, 4)))
    sender, content = X.trim_all(F.col("h")[2]), F.col("h")[3]
    header = F.col("h").isNotNull()
    notice = header & X.is_notice(sender, content) if config.skip_system_messages and not stream else F.lit(False)
    d = d.withColumn("notice", F.coalesce(notice, F.lit(False)))
    # Notices leave after the window only: a filter before it would be pushed down with all expressions inlined.
    d = running(d, "chat_id", "line_no", (header & ~F.col("notice")).cast("int"), "msg").where((F.col("msg") > 0) & ~F.col("notice"))
    text = F.when(header, content).otherwise(X.trim_all(F.concat(F.lit("."), "line")).substr(F.lit(2), F.length("line")) if stream else F.col("line"))
    d = d.withColumn("__text", text)
    g = d.groupBy("chat_id", "msg").agg(
        F.min_by(F.when(header, F.struct("h", "format")), F.when(header, F.col("line_no"))).alias("f"),
        F.expr("listagg(__text, '\n') WITHIN GROUP (ORDER BY line_no)").alias("content"),
        F.min("line_no").alias("seq"),
    )
    h = F.col("f.h")
    content = X.trim_all(F.col("content")) if stream else F.col("content")
    d = g.select("chat_id", "seq", X.trim_all(h[2]).alias("sender"), content.alias("content"), _whatsapp_stamp(h[0], h[1], F.col("f.format")).alias("timestamp"))
    if stream:
        d = d.where(X.not_blank(F.col("content")) & ~X.is_notice(F.col("sender"), F.col("content")))
    m = message(F.col("sender"), F.col("content"), F.col("timestamp"))
    return _messages(d, m, F.col("seq"))


# Fixed value: the header line of Discord text exports, with the groups time and sender.
_DISCORD_HEADER = r"(?d)^\[(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?)\]\s+(.+)$"


def _discord_stamp(s: Column) -> Column:
    n = lambda i: F.regexp_extract(s, r"^(\d+)/(\d+)/(\d+)\s+(\d+):(\d+)(?::(\d+))?\s*([AP]?)M?\s*$", i)
    sec = F.coalesce(n(6).try_cast("int"), F.lit(0))
    return X.local_stamp(n(3).try_cast("int"), n(1).try_cast("int"), n(2).try_cast("int"), n(4).try_cast("int"), n(5).try_cast("int"), sec, F.lower(n(7)))


def _txt_pieces(raw: Column) -> Column:
    """The messages of a text export, each from its header line on; what stands before the first comes as the first."""
    inside = _DISCORD_HEADER.replace(r"\s", r"[\s&&[^\n]]")
    return F.split(F.regexp_replace(_unix_lines(raw), "(?m)" + inside[:4] + "^(?=" + inside[5:-1] + "$)", _MARK), _MARK)


def _txt_message(x: Column) -> Column:
    """A header line, lines of text, then sections that a line with their name opens; a message, or null of a blank one."""
    body = F.regexp_replace(F.coalesce(_other_lines(x), F.lit("")), r"\n\{(A)ttachments\}(?=\n|\z)|\n\{(S)tickers\}(?=\n|\z)", f"{_PART}$1$2")
    parts = F.split(body, _PART)

    def items(part: Column) -> Column:
        name = lambda line: F.when(line.startswith("http"), X.last_segment(line)).otherwise(line)
        lines = F.transform(F.slice(F.split(part, "\n"), F.lit(2), F.size(F.split(part, "\n"))), X.trim_all)
        head = F.when(part.startswith("A"), "[Attachment: ").otherwise("[Sticker: ")
        return F.transform(F.filter(lines, lambda y: y != ""), lambda y: F.concat(head, name(y), F.lit("]")))

    sections = F.flatten(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), items))
    # The body keeps its blank lines; without a section the arrays need not be made.
    content = X.trim_all(F.when(F.size(parts) == 1, parts[0]).otherwise(F.concat_ws("\n", parts[0], F.when(F.size(sections) > 0, F.array_join(sections, "\n")))))
    h = lambda i: F.regexp_extract(_first_line(x), _DISCORD_HEADER, i)
    return F.when(X.not_blank(content), message(h(2), content, _discord_stamp(h(1))))


def parse_discord_txt(df: DataFrame, on_error: str | None = None, profile: str = "eager") -> DataFrame:
    """Headers open messages; lines ``{Attachments}`` and ``{Stickers}`` open sections, in which lines are placeholders."""
    d = df.select("chat_id", F.posexplode(_txt_pieces(F.col("raw"))).alias("pos", "x")).where(F.col("pos") > 0)
    return _messages(d, _txt_message(F.col("x")), F.col("pos"))


def _csv_message(row: Column) -> Column:
    content, files = F.coalesce(row["content"], F.lit("")), F.coalesce(row["attachments"], F.lit(""))
    text = X.append_lines(content, X.attachment_lines(X.url_names(files)))
    return F.when(X.not_blank(content) | X.not_blank(files), message(F.coalesce(row["author"], F.lit("")), text, X.rfc3339(row["date"])))


_CSV_ROWS = "array<struct<author_id:string,author:string,date:string,content:string,attachments:string>>"


def _csv_rows(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The records of CSV documents: quoted fields with line ends, short records allowed, the header left out."""
    csv.field_size_limit(2**31 - 1)
    for s in parts:
        out = []
        for text in s:
            if text is None:
                out.append(None)
                continue
            rows = list(csv.reader(io.StringIO(text, newline="")))[1:]
            out.append([{k: (r[i] if i < len(r) else None) for i, k in enumerate(("author_id", "author", "date", "content", "attachments"))} for r in rows if r])
        yield pd.Series(out)


def parse_discord_csv(df: DataFrame, on_error: str | None = None, profile: str = "eager") -> DataFrame:
    """Columns by position: id of the author, author, date, content, attachments. Documents in Arrow batches."""
    f = F.pandas_udf(_csv_rows, _CSV_ROWS)
    d = df.select("chat_id", F.posexplode(f("raw")).alias("pos", "r"))
    return _messages(d, _csv_message(F.col("r")), F.col("pos"))


def discord_kind(raw: Column, path: Column | None = None) -> Column:
    """``json``, ``csv`` or ``txt``: by the path's extension, else by how the content looks."""
    t = X.trim_all(raw)
    sniff = F.when(t.startswith("{"), "json").when(t.startswith("AuthorID,") | t.contains('","'), "csv").otherwise("txt")
    if path is None:
        return sniff
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("json", "csv", "txt"), ext).otherwise(sniff)


def parse_discord(df: DataFrame, config: DiscordConfig = DiscordConfig(), on_error: str | None = None, profile: str = "eager") -> DataFrame:
    """Documents of any of Discord's formats; a column ``path``, where there is one, tells by its extension.

    Each form has a parser of its own over its documents: one plan for all of them would be too long to be compiled, and
    takes several times as long as three reads.
    """
    d = df.select("chat_id", "raw", discord_kind(F.col("raw"), F.col("path") if "path" in df.columns else None).alias("__kind"))
    part = lambda k: d.where(F.col("__kind") == k)
    out = parse_discord_json(part("json"), config, on_error, profile)
    return out.unionByName(parse_discord_txt(part("txt"))).unionByName(parse_discord_csv(part("csv")))


PARSERS = {Platform.TELEGRAM: parse_telegram, Platform.WHATSAPP: parse_whatsapp, Platform.INSTAGRAM: parse_instagram, Platform.DISCORD: parse_discord}


def parse_chat(df: DataFrame, platform: Platform | str, config=None, **options) -> DataFrame:
    """Documents (``chat_id, raw``) of a platform as messages, by the platform's parser."""
    p = Platform.from_name(platform)
    if p not in PARSERS:
        raise InvalidFormatError(str(p), "no parser")
    return PARSERS[p](df, *([config] if config is not None else []), **options).select(*MESSAGE_COLUMNS)
