"""The entry points, and every query with SQL against DuckDB on the smallest test tables."""

import datetime as dt
import decimal
import os
import pickle

import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")
OWN = {k: v for k, v in entry.oracle_sql().items() if entry.queries()[k].__module__.startswith("chatloom.plans")}


def plain(x):
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, float):
        return round(x, 6)
    return str(x) if isinstance(x, decimal.Decimal) else x


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(BASE):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{BASE}/{f}')")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["chat_id", "seq", "line"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 4, 5, 7)} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, BASE)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(str(plain(r[c])) for c in columns)) for r in df.collect())
    cursor = duck.execute(OWN[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(str(plain(r[i])) for i in at)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", ["k_csv_string", "k_jsonl_string", "k_json_string"])
def test_strings_are_not_sent_to_tasks(spark, monkeypatch, name):
    """What the driver makes a table of goes to a task, which takes no more than spark.rpc.message.maxSize."""
    sent, kind = [], type(spark)
    real = kind.createDataFrame
    monkeypatch.setattr(kind, "createDataFrame", lambda self, data, *a, **k: sent.append(len(pickle.dumps(data))) or real(self, data, *a, **k))
    assert entry.queries()[name](spark, BASE).first()["n"] > 10_000
    assert sum(sent) < 1_000


def test_instants_of_the_tables(spark):
    """Stamps agree with most stored times, which are right but for the planted errors."""
    found = entry.queries()["p1_found"](spark, BASE)
    stamped = entry.queries()["p1_instants"](spark, BASE)
    assert found.columns == ["chat_id", "seq"]
    assert 0 < found.count() < 0.15 * stamped.where("instant IS NOT NULL").count()
    assert stamped.where("instant IS NULL").count() < 0.05 * stamped.count()
