import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from chatloom.config import DiscordConfig, InstagramConfig, Platform, WhatsAppConfig
from chatloom.errors import BufferOverflowError, InputOutputError, InvalidFormatError, ParseError, UnexpectedEndError, Utf8Error, translated, typed_errors
from chatloom.functions import text as X
from chatloom.operators.messages import merge_consecutive
from chatloom.sources.files import create_source, parse_strings, read_chat, read_large, submit
from chatloom.sinks.writers import to_csv
from chatloom.sources.json_array import JsonArraySource, scan_records
from chatloom.sources.parsers import discord_kind, parse_chat, parse_discord_jsonl


def rows(df, *cols):
    cols = cols or ("sender", "content", "time", "id", "reply_to")
    d = df.withColumn("time", F.date_format("timestamp", "HH:mm:ss")).withColumn("id", F.col("id").cast("string")).withColumn("reply_to", F.col("reply_to").cast("string"))
    return [tuple(r[c] for c in cols) for r in d.orderBy("chat_id", "seq").collect()]


def tg(*messages):
    return json.dumps({"name": "x", "messages": [{"type": "message", "from": "A", **m} for m in messages]})


def test_telegram_simple(spark):
    text = tg({"id": 1, "date_unixtime": "1705314600", "text": "Hello!"}, {"id": 2, "from": "Bob", "date_unixtime": "1705314660", "text": "Hi Alice!"},
              {"id": 3, "date_unixtime": "1705314690", "text": "How are you?"}, {"id": 4, "date_unixtime": "1705314720", "text": "I'm doing great!"})
    m = parse_strings(spark, text, "Telegram")
    assert rows(m, "sender", "time", "id") == [("A", "10:30:00", "1"), ("Bob", "10:31:00", "2"), ("A", "10:31:30", "3"), ("A", "10:32:00", "4")]
    assert rows(merge_consecutive(m), "content", "id")[2] == ("How are you?\nI'm doing great!", "3")


def test_telegram_text_variants(spark):
    texts = [None, 123, True, {"text": "x"}, [], "   ", ["A", {"type": "link", "text": "B"}, "C", {"text": "D"}], [{"no": 1}, "text"], "[1]", [["x"], 1, None], "{\"a\\\"}"]
    m = parse_strings(spark, tg(*[{"id": i, "text": t} for i, t in enumerate(texts)]), "tg")
    assert rows(m, "id", "content") == [("6", "ABCD"), ("7", "text"), ("8", "[1]"), ("10", "{\"a\\\"}")]
    assert rows(parse_strings(spark, tg({"id": 1, "text": "x", "type": "service"}, {"id": 2, "text": "x", "from": None}), "tg")) == []


def test_unix_seconds(spark):
    d = spark.createDataFrame([(s,) for s in ("0", "-1", "", "12.34", "123abc", "5\n", None, "9" * 30)], "s string")
    assert [r[0] for r in d.select(F.unix_seconds(X.unix_seconds(F.col("s")))).collect()] == [0, -1, None, None, None, None, None, None]


def test_bad_documents_and_records(spark):
    for bad in ("", "{", "[]", '{"messages": 3}'):
        with pytest.raises(Exception, match="no valid document"):
            parse_strings(spark, bad, "tg").collect()
        assert parse_strings(spark, bad, "tg", on_error="skip").count() == 0
    text = '{"messages": [{"id": 1, "type": "message", "from": "A", "text": "x"}, {"id": 2, "from": "A", "text": "y"}, 7]}'
    with pytest.raises(Exception, match="no valid document"):
        parse_strings(spark, text, "tg").collect()
    with pytest.raises(Exception, match="malformed record"):
        parse_strings(spark, text.replace(", 7", ""), "tg").collect()
    assert rows(parse_strings(spark, text, "tg", profile="streaming"), "id") == [("1",)]
    assert rows(parse_strings(spark, tg({"id": 1, "text": "x" * 100}, {"id": 2, "text": "y"}), "tg", create_source("tg", streaming=True).config.with_(max_message_size=90), profile="streaming"), "id") == [("2",)]


WA_US = """[1/15/24, 10:30:45 AM] Alice: Hello everyone!
[1/15/24, 10:31 AM] Bob: Hi Alice!
[1/15/24, 10:32:15 AM] Alice: How is everyone doing?
I hope

so
[1/15/24, 10:33:00 AM] Charlie: Messages and calls are end-to-end encrypted.
goes on
[1/15/24, 10:34:00 PM] Bob: I left home
[1/15/24, 12:00:00 AM] Bob:  blank first
[1/15/24, 10:36:00 AM] Bob left
[1/15/24, 10:37:00 AM] Al: """


def test_whatsapp_eager(spark):
    want = [("Alice", "Hello everyone!", "10:30:45"), ("Bob", "Hi Alice!", "10:31:00"), ("Alice", "How is everyone doing?\nI hope\nso\ngoes on", "10:32:15"),
            ("Bob", " blank first\n[1/15/24, 10:36:00 AM] Bob left", "00:00:00"), ("Al", "", "10:37:00")]
    assert rows(parse_strings(spark, WA_US, "wa"), "sender", "content", "time") == want
    assert rows(parse_strings(spark, "lost\r\n" + WA_US.replace("\n", "\r\n"), "wa"), "sender", "content", "time") == want
    kept = rows(parse_strings(spark, WA_US, "wa", WhatsAppConfig(skip_system_messages=False)), "sender", "content")
    assert ("Charlie", "Messages and calls are end-to-end encrypted.\ngoes on") in kept and ("Bob", "I left home") in kept


def test_whatsapp_streaming(spark):
    got = rows(parse_strings(spark, WA_US, "wa", profile="streaming"), "sender", "content")
    assert got == [("Alice", "Hello everyone!"), ("Bob", "Hi Alice!"), ("Alice", "How is everyone doing?\nI hope\nso")]  # "Bob left" makes the next one a notice


def test_whatsapp_formats(spark):
    one = lambda text, **o: rows(parse_strings(spark, text, "wa", **o), "sender", "time")
    assert one("15.01.2024, 10:30 - Алиса: Привет") == [("Алиса", "10:30:00")]
    assert one("[15.01.24, 10:30:45] A: x") == [("A", "10:30:45")]
    assert one("15/01/2024, 10:30 - A: x") == [("A", "10:30:00")]
    slash = "[05/06/2024, 10:30:45] A: x\n[25/01/2024, 10:30:45] B: y"
    d = lambda m: [r[0] for r in m.orderBy("seq").select(F.date_format("timestamp", "MM-dd")).collect()]
    assert d(parse_strings(spark, slash, "wa")) == ["05-06", None]
    assert d(parse_strings(spark, slash, "wa", WhatsAppConfig(disambiguate_slash=True))) == ["06-05", "01-25"]
    years = [r[0] for r in parse_strings(spark, "[1/2/99, 1:00] A: x\n[1/2/69, 1:00] A: y\n[1/2/199, 1:00] A: z", "wa").orderBy("seq").select(F.year("timestamp")).collect()]
    assert years == [1999, 2069, None]
    assert one("") == []
    with pytest.raises(Exception, match="unknown format"):
        one("just text")
    assert one("just text", profile="streaming") == []


def test_instagram(spark):
    raw = json.dumps({"messages": [
        {"sender_name": "u", "timestamp_ms": 1705314600000, "content": "cafÃ©"}, {"sender_name": "v", "timestamp_ms": 1705314660000, "share": {"share_text": "s", "link": "l"}},
        {"sender_name": "w", "timestamp_ms": 1, "content": ""}, {"sender_name": "x", "timestamp_ms": 2, "content": "é", "share": {"share_text": "t"}}, {"sender_name": "y", "timestamp_ms": 3},
    ]})
    assert rows(parse_strings(spark, raw, "ig"), "sender", "content") == [("x", "é"), ("v", "s"), ("u", "café")]
    assert rows(parse_strings(spark, raw, "ig", InstagramConfig(fix_encoding=False)), "content")[2] == ("cafÃ©",)
    assert rows(parse_strings(spark, raw, "ig", InstagramConfig(fix_encoding=False), profile="streaming"), "sender", "content") == [("u", "café"), ("v", "s"), ("x", "é")]


def test_low_byte_repair(spark):
    cases = {"abc": "abc", "": "", "é": "é", "cafÃ©": "café", "Привет".encode().decode("latin-1"): "Привет", "Привет": "\x1f@825B", None: None, "☕".encode().decode("latin-1"): "☕"}
    d = spark.createDataFrame([(k,) for k in cases], "s string")
    assert [r[0] for r in d.select(X.low_byte_repair(F.col("s"))).collect()] == list(cases.values())


def dc(**over):
    return {"id": "1001", "timestamp": "2024-01-15T10:30:00+00:00", "content": "Hi", "author": {"name": "n", "nickname": None}, **over}


def test_discord_json(spark):
    records = [
        dc(), dc(id="18446744073709551615", content="", attachments=[{"fileName": "a.png"}], stickers=[{"name": "Wave"}], reference={"messageId": "7"}, author={"name": "n", "nickname": ""}),
        dc(id="not", timestamp="2024-01-15", content="  ", attachments=[{"fileName": "b"}], timestampEdited="2024-01-15T10:32:00.5Z"), dc(content=" ", attachments=[]),
    ]
    raw = json.dumps({"messages": records})
    m = parse_strings(spark, raw, "dc")
    assert rows(m) == [("n", "Hi", "10:30:00", "1001", None), ("", "[Attachment: a.png]\n[Sticker: Wave]", "10:30:00", "18446744073709551615", "7"), ("n", "  \n[Attachment: b]", None, None, None)]
    assert rows(parse_strings(spark, raw, "dc", profile="streaming"), "content") == [("Hi",)]
    assert rows(parse_strings(spark, raw, "dc", DiscordConfig(prefer_nickname=False, include_attachments=False)), "sender", "content") == [("n", "Hi")]
    lines = spark.createDataFrame([("c", "\n".join([json.dumps(dc(reference={"messageId": "7"})), "", "{bad", json.dumps(dc(id="2"))]))], "chat_id string, raw string")
    assert rows(parse_discord_jsonl(lines), "id", "reply_to") == [("1001", None), ("2", None)]


def test_discord_txt(spark):
    rule = "=" * 62
    text = f"{rule}\nGuild: x\n{rule}\n\n[1/15/2024 10:30 AM] Alice\nHello Discord!\n\n[1/15/2024 10:31:05 PM] bob\n\nHi Alice!\n\n\n{{Attachments}}\nhttps://cdn/x/image.png\n\n[1/15/2024 10:33] Alice\n{{Stickers}}\n789.json\n\n{rule}\nExported 3 message(s)\n{rule}\n[1/15/2024 1:00 AM] E\n \n"
    want = [("Alice", "Hello Discord!", "10:30:00"), ("bob", "Hi Alice!\n\n\n[Attachment: image.png]", "22:31:05"),
            ("Alice", f"[Sticker: 789.json]\n[Sticker: {rule}]\n[Sticker: Exported 3 message(s)]\n[Sticker: {rule}]", "10:33:00")]
    assert rows(parse_strings(spark, text, "dc"), "sender", "content", "time") == want


def test_discord_csv(spark):
    out = io.StringIO()
    w = csv.writer(out, quoting=csv.QUOTE_ALL)
    w.writerows([["AuthorID", "Author", "Date", "Content", "Attachments", "Reactions"], ["1", "A", "2024-01-15T10:30:00+00:00", 'say "hi",\nyou', "", ""], ["2", "b", "x", "", "https://a/b/i.png, c ,", ""], ["3", "c", "", " ", " ", ""]])
    got = rows(parse_strings(spark, out.getvalue() + "4,short\n", "dc"), "sender", "content", "time")
    assert got == [("A", 'say "hi",\nyou', "10:30:00"), ("b", "[Attachment: i.png]\n[Attachment: c]", None)]
    d = spark.createDataFrame([("  {", "x.TXT"), ("a", "y.json"), ('1","2', "z"), ("AuthorID,", None), ("[1", "q.html")], "raw string, path string")
    assert [r[0] for r in d.select(discord_kind(F.col("raw"), F.col("path"))).collect()] == ["txt", "json", "csv", "csv", "txt"]


def test_files_and_factory(spark, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(tg({"id": 1, "text": "x"}))
    b.write_text(tg({"id": 2, "text": "y"}))
    m = read_chat(spark, [str(a), str(b)], Platform.TELEGRAM)
    assert rows(m, "id") == [("1",), ("2",)] and m.select("chat_id").distinct().count() == 2
    assert submit(create_source("telegram").parse(spark, str(a)).count).result() == 1
    with pytest.raises(InputOutputError):
        read_chat(spark, str(tmp_path / "none.json"), "tg").collect()
    assert parse_chat(spark.createDataFrame([], "chat_id string, raw string"), "wa").count() == 0


def test_record_scanner(spark, tmp_path):
    records = [{"a": "}]{[\"\\"}, {"b": {"c": [1, {"d": "x\\"}]}}, {}]
    text = json.dumps({"x": "\"messages\": [", "y": {"messages": [1]}, "messages": records, "z": [{}]}, indent=1)
    for size in (1, 2, 3, 7, 10**6):
        import chatloom.sources.json_array as J

        old, J.BLOCK = J.BLOCK, size
        try:
            got = [json.loads(t) for _, t in scan_records(io.StringIO(text).read)]
        finally:
            J.BLOCK = old
        assert got == records
    assert [t is None for _, t in scan_records(io.StringIO(text).read, largest=25)] == [False, True, False]
    with pytest.raises(UnexpectedEndError):
        list(scan_records(io.StringIO(text[: text.index("d")]).read))
    (tmp_path / "f.json").write_text(text)
    spark.dataSource.register(JsonArraySource)
    got = spark.read.format("chat_json_array").load(str(tmp_path / "f.json")).orderBy("pos").collect()
    assert [json.loads(r["item"]) for r in got] == records


def test_numbers_are_no_texts(spark):
    """A record with a field of a wrong JSON type is malformed: it fails the document, or is skipped alone."""
    good = {"id": 1, "date_unixtime": "1705314600", "text": "x"}
    for bad in ({"from": 5}, {"date_unixtime": 1705314600}, {"id": "1"}, {"id": -1}, {"id": 1.5}, {"type": True}, {"edited_unixtime": []}):
        raw = tg(good, {**good, **bad})
        with pytest.raises(ParseError) as e, typed_errors():
            parse_strings(spark, raw, "tg").collect()
        assert e.value.platform == "Telegram" and e.value.is_parse()
        assert len(rows(parse_strings(spark, raw, "tg", profile="streaming"))) == 1
    ig = lambda **x: json.dumps({"messages": [{"sender_name": "u", "timestamp_ms": 1, "content": "c", **x}]})
    for bad in ({"sender_name": 5}, {"timestamp_ms": "1"}, {"content": 3}, {"share": {"share_text": 1}}):
        assert parse_strings(spark, ig(**bad), "ig", on_error="skip").count() == 0
    assert rows(parse_strings(spark, ig(share=None), "ig"), "content") == [("c",)]
    for bad in ({"id": 1}, {"content": None}, {"author": {"name": 4}}, {"author": None}, {"timestamp": 7}):
        raw = json.dumps({"messages": [dc(**bad), dc()]})
        assert len(rows(parse_strings(spark, raw, "dc", on_error="skip"))) == 1
        with pytest.raises(ParseError), typed_errors():
            parse_strings(spark, raw, "dc").collect()
        lines = spark.createDataFrame([("c", json.dumps(dc(**bad)) + "\n" + json.dumps(dc()))], "chat_id string, raw string")
        assert parse_discord_jsonl(lines).count() == 1


def test_typed_errors(spark):
    with pytest.raises(InvalidFormatError), typed_errors():
        parse_strings(spark, "just text", "wa").collect()
    with pytest.raises(ParseError):
        to_csv(parse_strings(spark, "{", "tg"))
    with pytest.raises(ZeroDivisionError), typed_errors():
        1 / 0
    assert isinstance(translated(RuntimeError("UnicodeDecodeError: x")), Utf8Error) and translated(RuntimeError("x")) is None


def test_large_files(spark, tmp_path):
    """Read record by record and line by line, they give what whole documents give."""
    n = 3000
    (tmp_path / "t.json").write_text(tg(*[{"id": i, "text": f"m{i} }}{{"} for i in range(n)], {"from": 5}))
    got = rows(read_large(spark, str(tmp_path / "t.json"), "tg"), "id", "content")
    assert got == [(str(i), f"m{i} }}{{") for i in range(n)]
    with pytest.raises(ParseError), typed_errors():
        read_large(spark, str(tmp_path / "t.json"), "tg", on_error="fail").collect()
    with pytest.raises(BufferOverflowError), typed_errors():
        read_large(spark, "file://" + str(tmp_path / "t.json"), "tg", on_error="fail", max_record=20).collect()
    ig = json.dumps({"messages": [{"sender_name": "u", "timestamp_ms": i, "content": f"c{i}"} for i in range(20)]})
    (tmp_path / "i.json").write_text(ig)
    assert rows(read_large(spark, str(tmp_path / "i*.json"), "ig"), "content") == rows(parse_strings(spark, ig, "ig"), "content")
    text = "lost\n" + WA_US + "\n" + "\n".join(f"[1/15/24, 10:40:{i % 60:02d} AM] Al: line {i}\r\nmore {i}" for i in range(n))
    (tmp_path / "w.txt").write_text(text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        large = rows(read_large(spark, str(tmp_path / "w.txt"), "wa"), "sender", "content", "time")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert large == rows(read_chat(spark, str(tmp_path / "w.txt"), "wa"), "sender", "content", "time") and len(large) == n + 5
    assert not create_source("wa").supports_streaming and create_source("tg").stream_file(spark, str(tmp_path / "t.json")).count() == n
