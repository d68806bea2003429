"""Every query of the engine against its SQL in DuckDB."""

import pytest

from tests.conftest import normal
from pagemill.plans import queries, sessions

QUERIES, ORACLES = queries.QUERIES | sessions.QUERIES, queries.ORACLES | sessions.ORACLES

SLOW = {"engine_session", "cv_report"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, duck):
    ours = normal(QUERIES[name](spark, sf_dir).toPandas())
    theirs = normal(duck.execute(ORACLES[name]).df())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["page_id", "title", "decision", "confidence"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
