"""The density grid on a table that is longer than the reference's window of 168 hours, against its SQL."""

import duckdb
import pytest

from skyframe.plans import registry

from .test_registry import _text


@pytest.fixture(scope="module")
def long_table(tmp_path_factory):
    d = tmp_path_factory.mktemp("long")
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id + 3000000 * (event_id % 2) AS event_id) FROM '/root/testdata/sf0.001/events.parquet') TO '{d}/events.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ["g2_density_score", "g3_grid_offset", "g4_latest_scored", "g6_baseline_health"])
def test_whole_table_counts(spark, long_table, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{long_table}/events.parquet'")
    df, want = registry.queries()[name](spark, long_table), duck.sql(registry.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(_text, r)) for r in df.collect()) == sorted(tuple(_text(r[i]) for i in at) for r in want.fetchall())
