import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatloom.llm.mixing import limits, mix, shares, water_fill
from chatloom.llm.packing import best_fit, containers_used, coverage, pack, utilisation
from chatloom.llm.tokens import encoding, with_tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_every_constraint(sizes, rule):
    bins = best_fit(np.array(sizes, dtype=int), 100, 7, 100.0**2, rule)
    for b in set(bins.tolist()):
        own = [s for s, x in zip(sizes, bins) if x == b]
        assert sum(own) <= 100 and len(own) <= 7 and sum(s * s for s in own) <= 100**2
    if sizes:
        assert len(set(bins.tolist())) <= len(sizes)


def test_best_fit_is_tight():
    r = random.Random(1)
    sizes = np.array([r.randrange(1, 60) for _ in range(2000)])
    for rule in ("norm", "dot"):
        bins = best_fit(sizes, 100, 50, 100.0**2, rule)
        assert len(set(bins.tolist())) <= -(-sizes.sum() // 100) * 1.02 + 1
    assert list(best_fit(np.array([60, 40, 60, 40]), 100, 9, 1e9)) == [0, 0, 1, 1]
    assert len(set(best_fit(np.array([1] * 10), 100, 3, 1e9).tolist())) == 4  # the number of documents binds
    assert len(set(best_fit(np.array([50, 50]), 100, 9, 4000.0).tolist())) == 2  # the attention cost binds
    with pytest.raises(ValueError):
        best_fit(np.array([101]), 100, 3, 1e9)


def test_pack_keeps_a_cost_that_binds(spark):
    kinds = spark.createDataFrame([("large", 512)], "container_kind string, capacity_tokens int")
    d = docs(spark, 120)
    assert utilisation(pack(d, kinds, tokens_per_document=100), kinds, tokens_per_document=100).first()["bound_by_documents"] > 0
    assert containers_used(pack(d, kinds, tokens_per_document=100)).where("n_pieces > 5").count() == 0
    assert utilisation(pack(d, kinds, cost_share=0.25), kinds, cost_share=0.25).first()["bound_by_cost"] > 0
    used = {share: containers_used(pack(d, kinds, cost_share=share)).collect() for share in (1.0, 0.25)}
    assert all(r["n_pieces"] == 1 or r["attention_cost"] <= 0.25 * 512**2 for r in used[0.25])
    assert any(r["n_pieces"] > 1 and r["attention_cost"] > 0.25 * 512**2 for r in used[1.0])
    assert sum(r["n_tokens"] for r in used[0.25]) == sum(r["n_tokens"] for r in used[1.0]) and len(used[0.25]) > len(used[1.0])


def docs(spark, n=300):
    r = random.Random(2)
    word = "lantern kettle ladder parcel archive".split()
    rows = [(i, " ".join(r.choice(word) for _ in range(r.choice([0, 3, 20, 90, 700]))), r.choice(["a", "A ", "b", "c", None])) for i in range(n)]
    rows += [(n, None, "a"), (2**62 + 1, "kettle " * 3000, "b"), (n + 2, "ha" * 20000, "c"), (None, "ladder " * 90, "c")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_pack_covers_every_text_once(spark):
    d = docs(spark)
    kinds = spark.createDataFrame([("small", 64), ("large", 512), ("none", 0), (None, None)], "container_kind string, capacity_tokens int")
    sizes = {r["doc_id"]: r["n_tokens"] for r in with_tokens(d).collect()}
    for shard in (50, 8192):
        packed = pack(d.withColumn("piece", F.lit("x")), kinds, shard_items=shard)
        rows = packed.collect()
        for kind, cap in (("small", 64), ("large", 512)):
            by = {}
            for r in rows:
                if r["container_kind"] == kind:
                    by.setdefault(r["doc_id"], []).append((r["piece"], r["token_start"], r["token_end"]))
            assert set(by) == set(sizes)
            for k, parts in by.items():
                parts.sort()
                assert [p[0] for p in parts] == list(range(len(parts))) and parts[0][1] == 0 and parts[-1][2] == sizes[k]
                assert all(a[2] == b[1] and a[2] - a[1] == cap for a, b in zip(parts, parts[1:])) and (len(parts) == 1) == (sizes[k] <= cap)
            used = containers_used(packed.where(F.col("container_kind") == kind))
            assert used.where((F.col("n_tokens") > cap) | (F.col("attention_cost") > cap**2)).count() == 0
        u = {r["container_kind"]: r for r in utilisation(packed, kinds).collect()}
        assert u["large"]["filled"] > (0.85 if shard == 50 else 0.95)
        assert coverage(packed).where("NOT whole").count() == 0 and coverage(packed.where("piece > 0")).where("whole").count() == 0
    assert pack(d.limit(0), kinds).count() == 0


def test_pieces_decode_to_the_text():
    t = encoding()
    text = "Привет, 🐌 señor " * 50
    ids = t.encode_ordinary(text)
    assert b"".join(t.decode_bytes(ids[i : i + 64]) for i in range(0, len(ids), 64)).decode() == text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.one_of(st.just(0.0), st.floats(0.001, 1)), st.integers(0, 5)), min_size=1, max_size=6), st.integers(1, 5000))
def test_water_filling(rows, total):
    sizes = {str(i): n for i, (n, _, _) in enumerate(rows)}
    weights = {str(i): w for i, (_, w, _) in enumerate(rows)}
    most = {str(i): m for i, (_, _, m) in enumerate(rows)}
    got = water_fill(sizes, weights, most, total)
    cap = {s: sizes[s] * most[s] for s in sizes}
    assert all(-1e-6 <= got[s] <= cap[s] + 1e-6 for s in sizes)
    able = sum(cap[s] for s in sizes if weights[s] > 0)
    assert abs(sum(got.values()) - min(total, able)) < 1e-3
    free = [s for s in sizes if weights[s] > 1e-9 and got[s] < cap[s] - 1e-6]
    assert all(abs(got[s] / weights[s] - got[free[0]] / weights[free[0]]) < 1e-3 * (1 + got[free[0]] / weights[free[0]]) for s in free)


def test_mix(spark):
    d = docs(spark)
    targets = spark.createDataFrame([("a", 0.5, 3), ("B", 0.3, 1), ("gone", 0.2, 2), (None, 0.1, 1)], "source string, weight double, max_repeats int")
    sizes = {r["doc_id"]: r["n_tokens"] for r in with_tokens(d).collect()}
    m = mix(d.withColumn("copies", F.lit("x")), targets)
    rows = m.collect()
    assert {r["source"] for r in rows} == {"a", "b"} and all(r["n_tokens"] == sizes[r["doc_id"]] > 0 for r in rows)
    assert max(r["copies"] for r in rows if r["source"] == "a") <= 3 and max(r["copies"] for r in rows if r["source"] == "b") <= 1
    s = {r["source"]: r for r in shares(m, targets).collect()}
    assert set(s) == {"a", "b", "gone"} and s["gone"]["tokens"] == 0
    assert {r["source"]: (r["over"], r["unknown"]) for r in limits(m, d, targets).collect()} == dict.fromkeys(("a", "b", "gone"), (False, 0))
    assert limits(m.withColumn("copies", F.lit(9)), d, targets).where("over").count() == 2
    a, b = s["a"]["tokens"], s["b"]["tokens"]
    have = {k: sum(n for r, n in ((x, sizes[x["doc_id"]]) for x in d.collect()) if (r["source"] or "").strip().lower() == k) for k in ("a", "b")}
    want = water_fill(have, {"a": 0.5, "b": 0.3, "gone": 0.2}, {"a": 3, "b": 1, "gone": 2}, have["a"] + have["b"])
    longest = max(sizes.values())
    assert abs(a - want["a"]) <= longest and abs(b - want["b"]) <= longest
    assert sorted(map(tuple, mix(d, targets).collect())) == sorted(map(tuple, rows))  # the same each time
    assert sorted(map(tuple, mix(d, targets, seed=5).collect())) != sorted(map(tuple, rows))
    assert mix(d.limit(0), targets).count() == 0 and mix(d, targets.limit(0)).count() == 0
    small = {r["source"]: r["tokens"] for r in shares(mix(d, targets, total_tokens=2000), targets).collect()}
    assert small["a"] + small["b"] < 2000 + 2 * longest
