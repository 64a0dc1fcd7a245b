"""Every query with SQL against DuckDB, on the smallest tables."""

from collections import Counter
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from hearken.plans.registry import ORACLES, QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
# These train models; the driver runs them.
SLOW = {"saved_model", "stream_enrich", "stream_answers"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = Counter(tuple(shown(v) for v in r) for r in df.select(*columns).collect())
    answer = duck.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(answer.description)}
    assert sorted(at) == columns
    theirs = Counter(tuple(shown(r[at[c]]) for c in columns) for r in answer.fetchall())
    assert ours == theirs


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
