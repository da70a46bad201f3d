import json
import random

import pytest

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatloom.operators.dedup import deduplicate, number_id, repeated_ids
from chatloom.operators.flatten import (
    _read_deep, discord_attachment_table, discord_author_table, discord_role_table, instagram_share_table, nested_nodes, nodes, table_of, telegram_text_table, text_nodes,
)
from chatloom.operators.sessions import is_blank, sessionize

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_number_id(spark):
    texts = ["12", " 12 ", "+12", "00012", "１２", "18446744073709551615", "18446744073709551616", "", None, "12.5e3", "-1", "1.0", "x", "12\n", "0" * 40 + "7", "0"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [None if r[0] is None else int(r[0]) for r in d.orderBy("i").select(number_id(F.col("t"))).collect()]
    assert got == [12, 12, 12, 12, 12, 2**64 - 1, None, None, None, None, None, None, None, 12, 7, 0]


def test_deduplicate(spark):
    rows = [("a", 1, 3, "late"), ("a", 1, 1, "first"), ("a", 1, 1, "first"), ("a", 2, 5, "only"), ("b", 1, 1, "other chat"), ("a", None, 1, "n1"), ("a", None, 1, "n2"), (None, 1, 1, "n3")]
    d = spark.createDataFrame(rows, "chat string, id int, rank int, __copies string")
    got = deduplicate(d, ["chat", "id"], [F.col("rank"), F.col("__copies")])
    assert got.columns == d.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[1], rows[3], rows[4], rows[5], rows[6], rows[7]], key=repr)
    assert deduplicate(d.limit(0), ["chat", "id"], [F.col("rank")]).count() == 0
    assert {tuple(r) for r in repeated_ids(d, ["chat", "id"]).collect()} == {("a", 1, 3)}


def test_deduplicate_against_stored(spark):
    d = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "id int, v string")
    stored = spark.createDataFrame([(2, "kept")], "id int, v string")
    got = sorted(tuple(r) for r in deduplicate(d, ["id"], [F.col("v")], stored=stored).where("id is not null").collect())
    assert got == [(1, "x")]


def test_hot_key_is_cut_in_the_map_tasks(spark):
    d = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    got = deduplicate(d, ["k"], [F.col("v")])
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 1)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def sessions_by_hand(events, gap):
    out = {}
    for k, t in sorted(events):
        runs = out.setdefault(k, [])
        if runs and t - runs[-1][1] <= gap:
            runs[-1][1] = t
            runs[-1][2] += 1
        else:
            runs.append([t, t, 1])
    return sorted((k, *r) for k, rs in out.items() for r in rs)


def run_sessions(spark, events, gap, slice_us):
    d = spark.createDataFrame(events, "k string, us bigint").select("k", F.timestamp_micros("us").alias("ts"), F.lit(1).alias("__start"), F.lit("x").alias("__k0"))
    r = sessionize(d, ["k"], "ts", gap, slice_us)
    return sorted((x["k"], x["start_us"], x["end_us"], x["n_events"]) for x in r.collect())


@FEW
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-5000, 5000)), min_size=1, max_size=80), st.sampled_from([1, 7, 100, 1000]))
def test_sessions_match_a_plain_loop(spark, events, slice_us):
    assert run_sessions(spark, events, 50, slice_us) == sessions_by_hand(events, 50)


def test_sessions_edges(spark):
    assert run_sessions(spark, [("a", 0), ("a", 50), ("a", 101), ("a", 0)], 50, 1000) == [("a", 0, 50, 3), ("a", 101, 101, 1)]
    d = spark.createDataFrame([(None, 1), ("a", None)], "k string, us bigint").select("k", F.timestamp_micros("us").alias("ts"))
    assert sessionize(d, ["k"], "ts").count() == 0
    e = spark.createDataFrame([("a", 5, 1), ("a", 5, 1), ("a", 5, 2)], "k string, us bigint, seq int").select("k", "seq", F.timestamp_micros("us").alias("ts"))
    assert [r["n_events"] for r in sessionize(e, ["k"], "ts", event="seq").collect()] == [2]


def test_deduplicate_marks(spark):
    d = spark.createDataFrame([(1, "b"), (1, "a"), (2, "x"), (None, "n"), (None, "n"), (3, "q")], "id int, v string").withColumns({"__copies": F.lit(7), "__known": F.lit(8)})
    got = sorted((str(r["id"]), r["v"], r["n"]) for r in deduplicate(d, ["id"], [F.col("v")], mark="n").collect())
    assert got == [("1", "a", 2), ("2", "x", 1), ("3", "q", 1), ("None", "n", 1), ("None", "n", 1)]
    stored = spark.createDataFrame([(2,), (9,), (9,), (None,)], "id int")
    assert sorted(str(r["id"]) for r in deduplicate(d, ["id"], [F.col("v")], stored=stored).collect()) == ["1", "3", "None", "None"]


def test_is_blank(spark):
    d = spark.createDataFrame([(t,) for t in (None, "", " ", "\t\n", " ", "​", "x", "☕")], "t string")
    assert [r[0] for r in d.select(is_blank(F.col("t"))).collect()] == [True] * 6 + [False] * 2


def test_text_nodes():
    t = ["a", 7, None, {"type": "b", "text": "x", "href": "h"}, {"text": ["q", {"text": ["r"]}]}, ["no"], True]
    got = {n[0]: n for n in text_nodes(json.dumps(t))}
    assert set(got) == {"text[0]", "text[3]", "text[4]", "text[4].text[0]", "text[4].text[1]", "text[4].text[1].text[0]"}
    assert got["text[3]"][2:] == ("object", "b", "x", "h") and got["text[4].text[1].text[0]"][1] == [0, 4, 0, 1, 0, 0]
    for bad in (None, "", "{}", '"[1]"', "[1", "[NaN]", "12", "null", "[" * 5000):
        assert text_nodes(bad) == []
    assert len(text_nodes("[" + '"a",' * 20000 + '"b"]')) == 20001


def test_text_nodes_of_any_depth():
    n = 3000
    deep = '[{"text":' * n + '["end", {"a": {}, "b": [], "text": "x"}]' + "}]" * n
    got = text_nodes(deep)
    assert len(got) == n + 2 and got[-2][4] == "end" and len(got[-1][1]) == 2 * n + 2
    for t in ('[1, "a\\"b", {"text": ["q", [], {}, {"x": [1, {"y": null}], "text": []}]}, -2.5e3, true]', "[]", " [ {} ] "):
        assert _read_deep(t) == json.loads(t, parse_int=float)
    for bad in ("[1", "[1,]", '{"a" 1}', '{"a": 1', "[1] 2", "[}", "{,}", "", "[NaN]"):
        with pytest.raises(ValueError):
            _read_deep(bad)


def test_tables(spark):
    tg = spark.createDataFrame([(1, '["a",{"text":["b"]}]'), (2, None), (3, " [ ]"), (3, '["dup"]')], "rec_id bigint, text string")
    rows = {(r["rec_id"], r["path"]): r for r in telegram_text_table(tg).collect()}
    assert set(rows) == {(1, "text[0]"), (1, "text[1]"), (1, "text[1].text[0]"), (3, "text[0]")}
    assert rows[1, "text[1].text[0]"]["parent_path"] == "text[1]" and rows[1, "text[0]"]["parent_path"] is None
    schema = "rec_id bigint, author struct<id:string,name:string,nickname:string,roles:array<struct<id:string,name:string>>>, attachments array<struct<id:string,url:string,fileName:string,fileSizeBytes:bigint>>"
    dc = spark.createDataFrame([(1, ("9", "n", None, [None, ("5", None)]), [("1", "u", "f", 3), None, ("2", "v", "g", None)]), (2, None, []), (3, ("8", None, None, None), None)], schema)
    assert [r["author_id"] for r in discord_author_table(dc).orderBy("rec_id").collect()] == ["9", "8"]
    assert [(r["path"], r["parent_path"]) for r in discord_role_table(dc).collect()] == [("author.roles[1]", "author")]
    assert [r["path"] for r in discord_attachment_table(dc).collect()] == ["attachments[0]", "attachments[2]"]
    ig = spark.createDataFrame([(1, ("l", None)), (2, None)], "rec_id bigint, share struct<link:string,share_text:string>")
    assert [r["rec_id"] for r in instagram_share_table(ig).collect()] == [1]
    n = {tuple(r) for r in nested_nodes(tg, dc, ig).select("src", "rec_id", "path").collect()}
    labels = {r["path"]: (r["table"], r["label"], r["parent_label"], r["parent_path"]) for r in nested_nodes(tg, dc, ig).where("rec_id = 1").collect()}
    assert labels["author.roles[1]"] == ("author.roles", [1, 0, 3, 1], [1, 0], "author") and labels["author"] == ("author", [1, 0], None, None)
    assert labels["text[1].text[0]"] == ("text.text", [1, 1, 0, 0], [1, 1], "text[1]") and labels["attachments[2]"][1:3] == ([2, 2], None)
    x = spark.createDataFrame([(1, [([1, None, 3], ("v", [None, ("w",)]))])], "rec_id int, a array<struct<p:array<int>,q:struct<r:string,s:array<struct<t:string>>>>>")
    assert [r["path"] for r in nodes(x, "a").collect()] == ["a[0]", "a[0].p[0]", "a[0].p[2]", "a[0].q", "a[0].q.s[1]"]
    assert [(r["label"], r["parent_label"], r["node"]["t"]) for r in table_of(x, "a.q.s").collect()] == [([1, 0, 1, 0, 1, 1], [1, 0, 1, 0], "w")]
    assert len(n) == 4 + (1 + 1 + 2 + 1) + 1 and ("discord_raw", 1, "attachments[2]") in n
    assert nested_nodes(tg.limit(0), dc.limit(0), ig.limit(0)).count() == 0


def test_sessions_hot_key(spark):
    random.seed(1)
    events = [("hot", random.randrange(10**7)) for _ in range(2000)]
    assert run_sessions(spark, events, 3000, 50_000) == sessions_by_hand(events, 3000)
