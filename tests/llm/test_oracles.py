import duckdb
import pytest

from linkweave.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = registry.QUERIES[name](spark, sf)
    names = sorted(frame.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in frame.select(*names).collect()) == sorted(want)
