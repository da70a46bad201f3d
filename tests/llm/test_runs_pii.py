import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatloom.llm.pii import Finder, NameModel, found_items, name_model, redact
from chatloom.llm.runs import collapse_runs, dissimilarity, same_words, segment, words_of

SCHEMA = "chat_id string, seq bigint, sender string, content string, timestamp timestamp, edited timestamp, batch_no int, row_id bigint"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def spark_words():
    return []


def same(spark, a, b):
    d = spark.createDataFrame([(a, b)], "a string, b string").select(words_of(F.col("a")).alias("a"), words_of(F.col("b")).alias("b"))
    return d.select(same_words(F.col("a"), F.col("b"))).first()[0]


def test_same_words(spark):
    base = "Does anyone know whether the 12 lanterns are still at the harbour?"
    for other in ("DOES ANYONE KNOW WHETHER THE 12 LANTERNS ARE STILL AT THE HARBOUR", base.replace("harbour", "haaaarbour"), base.replace("whether", "wehther"), base.replace("anyone", "anyne"),
                  base + " 🐌!!", "  " + base.replace(" ", "  "), base.replace("still", "stilll")):
        assert same(spark, base, other)
    for other in (base.replace("12", "13"), base.replace("12", "112"), base.replace("harbour", "library"), base.replace("still", ""), base.replace("the harbour", "harbour the"), base + " now"):
        assert not same(spark, base, other)
    assert same(spark, "weiß schön", "WEISS SCHÖN") and same(spark, None, "") and same(spark, "!?", "!?") and not same(spark, "👍", "🎉") and not same(spark, "", "x")


def test_slips_that_merge_repeated_letters(spark):
    pairs = [("хорошо", "хоошо"), ("hahaha", "haahha"), ("ababab", "aaabbb"), ("hahaha хорошо banana", "haahha хоошо baanna")]
    pairs += [(f"{x} {x}", f"{y} {y}") for x, y in pairs]
    d = spark.createDataFrame(pairs, "a string, b string").select(words_of(F.col("a")).alias("a"), words_of(F.col("b")).alias("b"))
    got = d.select("a", same_words(F.col("a"), F.col("b")).alias("x"), same_words(F.col("b"), F.col("a")).alias("y")).collect()
    assert all(r["x"] and r["y"] for r in got), got
    assert not same(spark, "hahaha", "hoohho") and not same(spark, "хорошо да", "хоошо но")


def rows_of(spark, events):
    return spark.createDataFrame([(c, s, a, t, T0 + dt.timedelta(seconds=s) if s % 7 else None, T0 if t == "edited copy" else None, 1, i) for i, (c, s, a, t) in enumerate(events)], SCHEMA)


def runs_by_hand(events):
    out = []
    for c, s, a, t in sorted(events, key=lambda e: e[:2]):
        if out and out[-1][0] == c and a is not None and out[-1][3] == a and out[-1][4].lower() == t.lower():
            out[-1][2], out[-1][5] = s, out[-1][5] + 1
        else:
            out.append([c, s, s, a, t, 1])
    return sorted((c, f, last, n) for c, f, last, _, _, n in out)


def test_runs_match_a_plain_loop(spark):
    r = random.Random(5)
    events = [("c", s, r.choice(["A", "B", None, ""]), r.choice(["hello there", "HELLO there", "other words"])) for s in range(0, 300, 2)] + [("d", s, "A", "x") for s in range(40)]
    for bucket in (1, 5, 64, 100000):
        got = sorted((x["chat_id"], x["first_seq"], x["last_seq"], x["n_events"]) for x in collapse_runs(rows_of(spark, events), bucket=bucket).collect())
        assert got == runs_by_hand(events)


def test_runs_edges(spark):
    events = [("c", 1, "A", "edited copy"), ("c", 1, "A", "x"), ("c", 1, "A", "other copy"), ("c", 5, "A", "X!"), (None, 2, "A", "x"), ("d", 1, "A", None), ("d", 2, "A", ""), ("d", 3, None, "q"), ("d", 4, None, "q")]
    d = rows_of(spark, events).withColumns({"__w": F.lit(1), "__run": F.lit(2), "extra": F.lit(3)})
    got = sorted((x["chat_id"], x["first_seq"], x["last_seq"], x["n_events"], x["content"]) for x in collapse_runs(d).collect())
    assert got == [("c", 1, 5, 2, "x"), ("d", 1, 2, 2, None), ("d", 3, 3, 1, "q"), ("d", 4, 4, 1, "q")]
    first = collapse_runs(d).where("chat_id = 'c'").first()
    assert first["duration_us"] == 4_000_000
    assert collapse_runs(d.limit(0)).count() == 0


def cost(items, starts, near_cost, penalty):
    """Cost of a segmentation, straight from its definition."""
    total = 0.0
    for s, e in zip(starts, [*starts[1:], len(items)]):
        total += penalty + near_cost * min(max(dissimilarity(x, f) for x in items[s:e]) for f in items)
    return total


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["lantern at noon", "lantrn at noon", "lantrn t noon", "lanter at noon", "lantern at nooon", "ladder at dusk"]), min_size=1, max_size=9), st.sampled_from([(0.5, 1.0), (1.0, 0.2), (1.0, 0.4)]))
def test_pruned_recursion_is_optimal(items, costs):
    import itertools

    n = len(items)
    best = min(cost(items, [0, *c], *costs) for k in range(n) for c in itertools.combinations(range(1, n), k))
    got = [s for s, _ in segment(items, *costs)]
    assert abs(cost(items, got, *costs) - best) < 1e-9


def test_runs_have_a_form_that_fits_all_of_them():
    chain = ["abcdefgh", "abcdefg", "abcdef", "abcde", "abcd"]
    assert [s for s, _ in segment(chain)] in ([0, 2], [0, 3])  # each is near its neighbour, but no form is near all
    assert segment(["lantrn", "lanten", "lantern"]) == [(0, "lantern")]  # the first two are near the third only
    assert [s for s, _ in segment(["ab x", "ab y", "ab x"])] == [0, 1, 2]
    many = [w for i in range(60) for w in (f"word{chr(97 + i % 26)}{'x' * (i // 26 * 3)}", "other")]
    assert len(segment(many)) == 120


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("abcc1", min_size=1, max_size=6), st.text("abcc1", min_size=1, max_size=6))
def test_both_comparers_agree(spark_words, a, b):
    spark_words.append((a, b))


def test_comparers_agree_in_the_jvm(spark, spark_words):
    d = spark.createDataFrame(sorted(set(spark_words)), "a string, b string")
    got = d.select("a", "b", same_words(F.col("a"), F.col("b")).alias("x")).collect()
    assert [(r["a"], r["b"]) for r in got if r["x"] != (dissimilarity(r["a"], r["b"]) < float("inf"))] == []


NAMES = NameModel(["Kelvuta", "Kelvira", "Myrruta", "Myrrira", "Zoruta", "Zorira", "Kelvek", "Myrrek", "Zorek"],
                  ["Ostdahl", "Ostfell", "Ostmoor", "Grydahl".replace("yd", "ydd"), "Gryddfell", "Gryddmoor", "Wexdahl", "Wexfell", "Wexmoor", "O'Wexdahl", "Unique", None, ""])


def kinds(text):
    return Finder(NAMES).kinds(text)


def test_items_of_each_kind():
    f = Finder(NAMES)
    cases = {
        "email": ["write to a.b+c@mail.example.org, ok", "<A_B@X.ORG>", "mailto:x@y.example", "x [at] y [dot] org now", "x(at)y.org", "me at mail dot example dot net"],
        "phone": ["+49 30 23125 131", "030/23125119!", "(0999) 66 145 66", "call 297-555-0130", "+1 (243) 555-0109", "01.99.00.85.51", "020 7946 0164", "+999964417366"],
        "id_number": ["passport no. XK3228148", "666-12-6017", "ZZ 00 94 94 94 Q", "00/741/11741", "00046653-R", "L7X0-42712-K", "2995 48745 000", "000183-99-83", "my tax number: 77 123 456 78"],
        "address": ["128 Old Quill Lane, Nordhaven", "Oldquillweg 126, 00576 Lower Fenby", "ул. Тихоречная, д. 158, кв. 39", "Flat 3, 2 Old Quill Rd, X 00579", "Rua das Âncoras, 70, X", "Calle del Farol 115", "12 bis, rue des Brumes", "at 98 old quill lane, apt 19b"],
        "name": ["Kelvuta Ostdahl", "Ostdahl, Kelvuta", "Dr. Wexmoor", "K. T. Gryddfell", "ZOREK O'WEXDAHL", "kelvira wexfell-ostmoor", "Ms Unique"],
    }
    for kind, texts in cases.items():
        for t in texts:
            assert f.kinds(t) == [kind], t
    for t in ("ping @bluefinch43 at 12", "meet @ 37 minutes past", "ticket TRK-43-51-7", "[Attachment: IMG_31052048.pdf]", "v2.20.3, build 2024-0132", "from 09:51 to 10:39, see 2024-03-11",
              "host 192.0.2.43", "12 lane changes on page 29", "chapter 17 Court Games", "€ 5772", "Wexmoor alone", "kelvuta_ostdahl", "kelvuta.ostdahl", "Kelvuta said hi", "order 4859-1035", "", "  ", None, "1 200 22",
              "coordinates 12.12, -7.15", "Room 44, Second Floor, bring chairs", "a significant 12"):
        assert f.kinds(t) == [], t


def test_items_inside_others_dont_count_and_text_stays():
    f = Finder(NAMES)
    t = "cc kelvuta.ostdahl5@example.org or Kelvuta Ostdahl, +49 30 23125 131 — ünd 🐌"
    assert f.redacted(t) == "cc [EMAIL] or [NAME], [PHONE] — ünd 🐌"
    assert f.redacted("İ İ Kelvuta Ostdahl İ") == "İ İ [NAME] İ"
    assert f.redacted(None) is None and f.redacted("") == ""
    long = "x " * 200_000 + "a@b.example" + " y" * 200_000
    assert f.items(long) == [(400_000, 400_011, "email")]


def test_items_longer_than_any_window():
    f = Finder(NAMES)
    host = ".".join(["b" * 40] * 5) + ".example"
    for kind, item in (("email", "a" * 60 + "@" + host), ("address", "12 " + "Q" * 300 + " Lane, X"), ("address", "Oldquill" * 60 + "weg 12"), ("name", "Kelvuta" + " " * 50 + "Ostdahl"), ("id_number", "passport " + "AB-" * 30 + "123456")):
        assert f.kinds(item) == [kind], item
    assert f.kinds("call tel:+4930231251311") == ["phone"] and f.kinds("x sip:ann@host.example") == ["email"]
    assert f.redacted("see mailto:a@b.example.") == "see [EMAIL]."


def test_finder_stays_linear():
    """No text of long tokens, repeated words, digits or anchors makes the finder slow."""
    import time

    n = 100_000
    parts = ["1", "12 ", "1-", "(12)", "+1 ", "A1", "@", "a@", "b.", "a dot ", "x at y dot ", " street", "12 old street ", "weg", "weg 12 ", "rue ", "12, rue ", "ул. ", "ул.я", "я", "passport ", "passport 1 ",
             "ostdahl", "ostdahl-", "ostdahl, ", "Kelvuta ", "dr. ", "flat 3, ", "tel:12 ", "mailto:", "'", "İ", " ", "\n"]
    texts = [p * n for p in parts] + ["ул. " + "я" * n, "ул. " + "я я" * n, "passport " + "1-" * n + "é", "12 " + "a" * n + " street 5", "12 old street" + ", Abc" * n, "a@" + "b-" * n + "c.org", "Kelvuta " * n + "Ostdahl", "(" * n + "at)"]
    f = Finder(NAMES)
    for t in texts:
        began = time.time()
        f.items(t)
        assert time.time() - began < 8, t[:40]


def test_over_tables(spark):
    contacts = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate([("Kelvuta", "Ostdahl"), (None, None), ("Zorek", "Wexmoor")])], "person_id int, given_name string, family_name string")
    m = spark.createDataFrame([("c", 1, "a@b.example", "Kelvuta Ostdahl"), ("c", 1, "a@b.example", "Kelvuta Ostdahl"), ("c", 2, None, None), ("c", 3, "x", "")], "chat_id string, seq bigint, content string, sender string")
    names = name_model(contacts)
    assert sorted(map(tuple, found_items(m, names).collect())) == [("c", 1, "content", "email"), ("c", 1, "sender", "name")]
    r = redact(m.withColumn("kind", F.lit("k")), names).orderBy("seq").collect()
    assert (r[0]["content"], r[0]["sender"], r[0]["kind"], r[2]["content"]) == ("[EMAIL]", "[NAME]", "k", None)
    assert found_items(m.limit(0), name_model(contacts.limit(0))).count() == 0
