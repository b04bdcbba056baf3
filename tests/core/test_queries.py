import datetime
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__ as entry
from linkweave import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return str(round(v, 6)) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    frame = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    got = frame.collect()
    if name in catalog.ORACLES:
        result = con.execute(catalog.ORACLES[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(frame.columns)
        assert rows(frame.columns, got) == rows(columns, result.fetchall())


def test_newest_entry_is_aggregated_before_the_shuffle(spark):
    plan = catalog.QUERIES["agg13_newest_entry"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "collect_list" not in plan


def test_entry_contract(spark):
    assert entry.entry(spark).columns == ["unique_id", "source", "description", "posted_at", "links"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
