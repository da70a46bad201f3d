import datetime as dt
import json
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatloom.config import FilterConfig, OutputConfig, OutputFormat, Platform
from chatloom.errors import InvalidDateError, InvalidFormatError
from chatloom.operators.messages import ProcessingStats, apply_filters, chunk_by_time, merge_consecutive, processing_stats, project
from chatloom.operators.ordered import running
from chatloom.progress import Progress, ProgressListener
from chatloom.schema import from_model_json, from_rows, to_model_json
from chatloom.sinks.writers import to_csv, to_json, to_jsonl, write_dir, write_single
from chatloom.streaming.streams import process_stream, stream_chat, stream_discord_jsonl

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
T0 = dt.datetime(2024, 1, 15, 10, 0)


def msgs(spark, *pairs, **times):
    return from_rows(spark, [{"sender": s, "content": c, "id": i + 1, "timestamp": times.get("at", {}).get(i)} for i, (s, c) in enumerate(pairs)])


def contents(df):
    return [(r["sender"], r["content"]) for r in df.orderBy("seq").collect()]


def test_filters(spark):
    day = dt.datetime(2024, 1, 15)
    stamps = [day, day.replace(hour=23, minute=59, second=59), day.replace(hour=23, minute=59, second=59, microsecond=500000), None]
    m = from_rows(spark, [{"sender": s, "timestamp": t} for s, t in zip(["Alice", "ALICE", "alice", "Älice"], stamps)])
    assert apply_filters(m, FilterConfig().with_sender("aLiCe")).count() == 3
    assert apply_filters(m, FilterConfig().with_user("älice")).count() == 0
    f = FilterConfig().with_date_from("2024-01-15").with_date_to("2024-01-15")
    assert [r["seq"] for r in apply_filters(m, f).orderBy("seq").collect()] == [0, 1]
    assert apply_filters(m, FilterConfig()) is m and f.is_active() and f.has_date_filter() and not f.has_user_filter()
    for bad in ("01-15-2024", "2024/01/15", "2023-02-29", "2024-13-01", "", "x"):
        with pytest.raises(InvalidDateError):
            FilterConfig().with_date_from(bad)


def merged_by_hand(pairs):
    out = []
    for s, c in pairs:
        if out and out[-1][0] == s:
            out[-1] = (s, out[-1][1] + "\n" + c)
        else:
            out.append((s, c))
    return out


@FEW
@given(st.lists(st.tuples(st.sampled_from(["A", "B", ""]), st.sampled_from(["", "x", "y\nz"])), min_size=1, max_size=40), st.sampled_from([1, 3, 1000]))
def test_merge_matches_a_plain_loop(spark, pairs, bucket):
    m = merge_consecutive(msgs(spark, *pairs), bucket)
    assert contents(m) == merged_by_hand(pairs)
    assert contents(merge_consecutive(m, bucket)) == contents(m)


def test_merge_keeps_the_first_and_other_columns(spark):
    m = msgs(spark, ("A", "Hello"), ("A", ""), ("A", "World"), ("B", "x")).withColumns({"b": F.col("seq"), "row": F.lit("r"), "text": F.lit("t")})
    r = merge_consecutive(m, 2).orderBy("seq").collect()
    assert [(x["content"], int(x["id"]), x["b"], x["row"]) for x in r] == [("Hello\n\nWorld", 1, 0, "r"), ("x", 4, 3, "r")]
    assert merge_consecutive(m.limit(0)).count() == 0
    null = m.withColumn("sender", F.lit(None).cast("string"))
    assert merge_consecutive(null).count() == 1


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=50), st.sampled_from([1, 4, 1000]), st.booleans(), st.sampled_from(["sum", "max"]))
def test_running(spark, values, bucket, before, kind):
    d = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i bigint, v int")
    got = [r["out"] for r in running(d, "k", "i", F.col("v"), "out", kind, before, bucket).orderBy("i").collect()]
    for i, g in enumerate(got):
        seen = [v for v in values[: i + (not before)] if v is not None]
        assert g == (sum(seen) if kind == "sum" else max(seen, default=None))


def test_stats(spark):
    m = msgs(spark, ("A", "x"), ("A", "y"), ("B", "z"))
    s = processing_stats(m, merge_consecutive(m))
    assert (s.original, s.merged, s.messages_saved(), str(s)) == (3, 2, 1, "3 → 2 messages (33.3% reduction)")
    empty = processing_stats(m.limit(0), m.limit(0))
    assert (empty.compression_ratio(), empty.merge_ratio(), empty.messages_saved()) == (0.0, 1.0, 0)
    assert ProcessingStats(10, 3).with_filtered(2).messages_saved() == 0


def chunks_by_hand(rows, window):
    out, start = [], None
    for i, t in rows:
        new = not out or (t is not None and (start is None or int((t - start).total_seconds() / 60) > window))
        if new:
            out.append([])
            start = t
        out[-1].append(i)
    return out


def test_chunks(spark):
    for seed in range(4):
        r = random.Random(seed)
        rows = [(i, None if r.random() < 0.15 else T0 + dt.timedelta(seconds=r.choice([i * 100, i * 100 - 900, i * 1000]))) for i in range(60)]
        m = msgs(spark, *[("A", str(i)) for i, _ in rows], at=dict(rows))
        got = [[int(x) - 1 for x in c["message_ids"]] for c in chunk_by_time(m, 5).orderBy("chunk_no").collect()]
        assert got == chunks_by_hand(rows, 5)


def test_chunk_example(spark):
    at = {i: T0 + dt.timedelta(minutes=x) for i, x in enumerate((0, 1, 2, 3, 35, 36))}
    m = msgs(spark, ("Alice", "a"), ("Bob", "b"), ("Bob", "c"), ("Alice", "d"), ("Alice", "e"), ("Bob", "f"), at=at)
    ids = lambda d: [[int(x) for x in c["message_ids"]] for c in chunk_by_time(d, 5).orderBy("chunk_no").collect()]
    assert ids(m) == [[1, 2, 3, 4], [5, 6]]
    assert ids(merge_consecutive(m)) == [[1, 2, 4], [6]]
    c = chunk_by_time(m, 5).orderBy("chunk_no").first()
    assert (c["id"], c["text"], c["sender"]) == ("chunk_0", "Alice: a\nBob: b\nBob: c\nAlice: d", "Alice")


def sample(spark):
    rows = [{"sender": "A;B", "content": 'say "hi"\nthere, \u001f', "timestamp": dt.datetime(2024, 1, 15, 10, 30, 0, 999999), "id": 2**64 - 1, "reply_to": 1}, {"sender": " x ", "content": "", "edited": T0}]
    return from_rows(spark, rows)


def test_strings(spark):
    m, every = sample(spark), OutputConfig.all()
    assert to_csv(m, every) == 'ID;Timestamp;Sender;Content;ReplyTo;Edited\n18446744073709551615;2024-01-15 10:30:00;"A;B";"say ""hi""\nthere, \u001f";1;\n;; x ;;;2024-01-15 10:00:00\n'
    assert json.loads(to_json(m, every))[0] == {"sender": "A;B", "content": 'say "hi"\nthere, \u001f', "timestamp": "2024-01-15T10:30:00Z", "id": 2**64 - 1, "reply_to": 1}
    assert to_json(m.where("seq = 1"), every) == '[\n  {\n    "sender": " x ",\n    "content": "",\n    "edited": "2024-01-15T10:00:00Z"\n  }\n]'
    assert to_jsonl(m).split("\n")[0] == '{"sender":"A;B","content":"say \\"hi\\"\\nthere, \\u001f"}'
    none = m.limit(0)
    assert (to_csv(none), to_json(none), to_jsonl(none)) == ("Sender;Content\n", "[]", "")
    assert project(m, OutputConfig().with_ids()).columns == ["sender", "content", "id"]


def test_strings_come_in_blocks(spark, monkeypatch):
    """Messages reach the driver many at a time, and the borders of blocks don't show."""
    texts = ["x", 'q";\n', "é\U0001f600", "", "y" * 400]
    m = from_rows(spark, [{"sender": str(i), "content": texts[i % 5]} for i in range(20000)]).repartition(7)
    kind, rows = type(m), []
    real = kind.toLocalIterator
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, *a, **k: (rows.append(r) or r for r in real(self, *a, **k)))
    want = [{"sender": str(i), "content": texts[i % 5]} for i in range(20000)]
    assert to_json(m) == json.dumps(want, indent=2, ensure_ascii=False)
    assert to_jsonl(m) == "".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) + "\n" for x in want)
    assert 2 < len(rows) < 200


def test_files(spark, tmp_path):
    m = sample(spark)
    for name, text in (("a.csv", to_csv(m)), ("a.json", to_json(m)), ("a.jsonl", to_jsonl(m))):
        write_single(m, str(tmp_path / name))
        assert (tmp_path / name).read_text() == text
    write_dir(m, str(tmp_path / "c"), "csv")
    back = spark.read.csv(str(tmp_path / "c"), sep=";", header=True, multiLine=True, quote='"', escape='"')
    assert {r["Sender"] for r in back.collect()} == {"A;B", " x "}
    write_dir(m, str(tmp_path / "j"), "jsonl")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    write_dir(m.limit(0), str(tmp_path / "e"), "csv")
    assert "Sender;Content" in "".join(p.read_text() for p in (tmp_path / "e").glob("*.csv"))


def test_model_json(spark):
    m = sample(spark)
    assert [tuple(r) for r in from_model_json(to_model_json(m)).orderBy("seq").collect()] == [tuple(r) for r in m.orderBy("seq").collect()]


def test_enums_and_progress():
    assert Platform.from_name("WA") is Platform.WHATSAPP and OutputFormat.from_name("NDJSON") is OutputFormat.JSONL
    assert OutputFormat.from_path("x/y.CSV").mime_type == "text/csv" and Platform.TELEGRAM.default_extension == "json"
    for f, x in ((Platform.from_name, "icq"), (OutputFormat.from_name, "xml"), (OutputFormat.from_path, "noext")):
        with pytest.raises(InvalidFormatError):
            f(x)
    p = Progress(50, 200, 3).with_items(4)
    assert (p.percentage(), p.items_percentage(), p.is_complete(), p.remaining_bytes()) == (25.0, 75.0, False, 150)
    assert Progress(0, 0).percentage() == 100.0 and Progress(5).percentage() is None and Progress(9, 5).remaining_bytes() == 0


def test_streams(spark, tmp_path):
    inbox = tmp_path / "tg"
    inbox.mkdir()
    for k in range(3):
        (inbox / f"{k}.json").write_text(json.dumps({"messages": [{"id": i, "type": "message", "from": "A", "text": f"m{i}"} for i in range(5)] + [{"id": 9}]}))
    seen = []
    listener = ProgressListener(seen.append)
    spark.streams.addListener(listener)
    q = stream_chat(spark, str(inbox), "tg", max_files=1).writeStream.format("memory").queryName("tg").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert spark.table("tg").count() == 15
    deadline = time.time() + 20
    while time.time() < deadline and not (seen and seen[-1].bytes_processed):
        time.sleep(0.2)
    assert seen[-1].bytes_processed > 0 and seen[-1].items_processed > 0
    spark.streams.removeListener(listener)
    lines = tmp_path / "dc"
    lines.mkdir()
    ok = {"id": "1", "timestamp": "2024-01-15T10:30:00Z", "content": "x", "author": {"name": "n"}}
    (lines / "a.jsonl").write_text("\n".join([json.dumps(ok), "{bad", json.dumps({"id": "2"})]))
    q = stream_discord_jsonl(spark, str(lines)).writeStream.format("memory").queryName("dc").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert [r["content"] for r in spark.table("dc").collect()] == ["x"]
    wa = tmp_path / "wa"
    wa.mkdir()
    (wa / "chat.txt").write_text("[15.01.24, 10:30:00] A: x\nmore\n[15.01.24, 10:31:00] B: y\n")
    got = []
    process_stream(spark, str(wa), "wa", lambda d, n: got.extend(contents(d)), str(tmp_path / "c3")).awaitTermination(120)
    assert got == [("A", "x\nmore"), ("B", "y")]
    with pytest.raises(ValueError):
        stream_chat(spark, str(wa), "wa")
