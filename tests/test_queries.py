"""Every query with SQL against DuckDB on the same tables."""

import os

import duckdb
import pytest

from wirespark.plans.queries import ORACLE_SQL, QUERIES


def plain(rows, names):
    return sorted((tuple(r[c] for c in names) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{data}/{f}')")
    df = QUERIES[name](spark, data)
    con.execute(ORACLE_SQL[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(df.columns)
    want = con.fetchall()
    assert want
    got = plain(df.collect(), names)
    want = sorted(want, key=repr)
    assert len(got) == len(want)
    assert next(((g, w) for g, w in zip(got, want, strict=True) if g != w), None) is None


def test_space_of_whole_texts(spark, tmp_path):
    runs = ["", " ", "\n", " \t\r\n" * 9, "\u2028", "\u0085", "\u00a0"]
    texts = [None, *(a + b + c for a in runs for b in ("", "x", "x \n y") for c in runs)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    con.execute(ORACLE_SQL["ws_tests"])
    names = [c[0] for c in con.description]
    got = plain(QUERIES["ws_tests"](spark, str(tmp_path)).collect(), names)
    assert got == sorted(con.fetchall(), key=repr)
    assert {r[names.index("lead")] for r in got} >= {0, 1, 36} and {r[names.index("trail")] for r in got} >= {0, 1, 36}


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert sorted(r["r_name"] for r in entry.entry(spark).collect()) == sorted(r["r_name"] for r in spark.read.parquet("/root/testdata/sf0.001/region.parquet").collect())
    assert set(entry.oracle_sql()) <= set(entry.queries())
