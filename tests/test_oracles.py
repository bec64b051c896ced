"""Every query of the engine against DuckDB on the smallest tables."""

import pytest

from cuemill.plans import ORACLES, QUERIES
from cuemill.plans.views import WORDS
from tests.compare import differs, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_all_have_oracles():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    assert differs(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_word_upsert_returns_every_word(spark, sf, con):
    got = QUERIES["word_upsert"](spark, sf)
    assert got.columns == ["ytid", "source", "idx", "word", "start_ms", "end_ms", "seg"]
    n = con.execute(f"WITH {WORDS} SELECT count(*) FROM words").fetchone()[0]
    assert got.count() == got.select("ytid", "source", "idx").distinct().count() == n
    assert con.execute(f"SELECT count(*) FROM ({ORACLES['word_upsert']})").fetchone()[0] == n


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
