"""Every query of the subpackage on the smallest test tables."""

import os

import pytest

from chatloom.llm.queries import ORACLE_SQL, QUERIES

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")

COLUMNS = {
    "p2_found": ["rec_id", "field"],
    "p3_found": ["chat_id", "first_seq", "last_seq"],
    "p6_found": ["chat_id", "seq", "field", "kind"],
    "p10_found": ["doc_id", "kind"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, BASE)
    assert df.columns == COLUMNS.get(name, df.columns)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(BASE):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{BASE}/{f}')")
    df = QUERIES[name](spark, BASE)
    columns = sorted(df.columns)
    plain = lambda x: round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())


def test_types_agree_with_the_labels(spark):
    got = QUERIES["p10_types"](spark, BASE).select("doc_id", "kind")
    labels = spark.read.parquet(f"{BASE}/doc_labels.parquet").withColumnRenamed("kind", "label").where("label IS NOT NULL")
    rows = got.join(labels, "doc_id").collect()
    assert sum(r["kind"] == r["label"] for r in rows) >= 0.95 * len(rows)


def test_redacted_texts_hold_no_items(spark):
    from chatloom.llm.pii import found_items, name_model

    names = name_model(spark.read.parquet(f"{BASE}/contacts.parquet"))
    again = found_items(QUERIES["p6_redacted"](spark, BASE), names)
    assert again.count() == 0
