"""Every query with SQL against a single-node engine on the smallest tables, and the recorded figures."""

import datetime
import decimal
import os

import duckdb
import pytest

from emberlog.plans.oracle import ORACLE_SQL
from emberlog.plans.queries import QUERIES
from emberlog.plans.store import Store

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    got = sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())


def test_recorded_figures(spark):
    s = Store(spark, SF)
    assert s.raw.count() == 1000
    assert s.raw.select("block_id").distinct().count() == 62
    assert {r.label: r["count"] for r in s.labels.groupBy("label").count().collect()} == {"Anomaly": 18, "Normal": 42}
    assert s.windows.count() == 87
    assert s.static_incidents.count() == 41
    assert s.activity.count() == 24
    assert {r.severity: r["count"] for r in s.incidents.groupBy("severity").count().collect()} == {"HIGH": 3, "MEDIUM": 39}
    assert s.episodes.count() == 32
    assert {r.anomaly_score: r["count"] for r in s.scores.groupBy("anomaly_score").count().collect()} == {0: 12, 2: 1, 3: 3, 4: 12, 5: 5, 6: 29}
