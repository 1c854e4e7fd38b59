"""All training-data queries are registered, so a broken import inside the subpackage cannot pass as its absence."""

import duckdb

import __spark_entry__ as E


def test_all_numbered_queries_and_the_pipeline():
    names = [n for n in E.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert "op11_collocations" in E.oracle_sql()


def test_collocations_equal_their_sql(spark):
    folder, name = "/root/testdata/sf0.01", "op11_collocations"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(E.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = E.queries()[name](spark, folder)
    assert got.columns == columns
    rows = sorted(tuple(r) for r in got.collect())
    assert len(rows) > 50 and rows == sorted(want.fetchall())
