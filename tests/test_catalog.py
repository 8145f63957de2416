"""Every registered query of the engine beside its SQL, on the smallest tables."""

import duckdb
import pytest
from compare import connect, differences

from loomgraph import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_durations_of_large_event_ids(spark, tmp_path):
    """Like SQL wherever a bigint holds the cube (doubles beside a half included), and like exact whole numbers beyond."""
    fit, beyond = [None, -3, 0, 9, 10, 99, 100, 1500, 162_556, 999_999, 1_400_005, 2_097_151], [2_097_152, 2_100_848, 2_600_005, 5_999_999]
    for name, ids in (("fit", fit), ("all", fit + beyond)):
        (tmp_path / name).mkdir()
        spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / name / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/fit/events.parquet/*.parquet'")
    assert differences(catalog.duration_text(spark, str(tmp_path / "fit")), con, catalog.ORACLES["duration_text"]) is None
    got = {r.event_id: r for r in catalog.duration_text(spark, str(tmp_path / "all")).collect()}
    assert len(got) == len(fit + beyond)
    for i in beyond:
        ns = float(i**3)
        assert (got[i].text, got[i].ms) == (f"{ns / 1e9:.2f}s", round(ns / 1e6 * 1e6) / 1e6)
