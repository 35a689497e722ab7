"""Every registered query against its SQL check, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from registry.core import QUERIES, oracle
from tests.conftest import SMALL
from tools.check import compare, connect

ORACLE = oracle()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SMALL, QUERIES[name], ORACLE.get(name))
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["signal_id", "n_semitones", "source", "n_out", "peak_pcm"]
    assert df.count() > 0


def test_every_query_is_checked():
    assert set(ORACLE) == set(QUERIES)
