"""The driver's contract; SQL and queries agree on the smallest tables where they are there."""

import importlib
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
entry = importlib.import_module("__spark_entry__")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "p5_found" in entry.queries()


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["hybrid_search", "sparse_topk", "confidence", "url_normalize", "upsert_documents", "weekly_trends", "pii_counts", "p5_found"])
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, str(DATA))
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    plain = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(*names).collect()) == plain(found.fetchall())
