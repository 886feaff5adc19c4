"""Every registered query against its SQL, or for rows where there is none."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry_point
from tabweave.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 3
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_without_training_data(monkeypatch):
    """A missing library of the training-data part leaves all other queries."""
    import sys
    for name in [m for m in sys.modules if m.startswith("tabweave.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    monkeypatch.delattr("tabweave.llm", raising=False)
    assert set(entry_point.queries()) == set(QUERIES)
    assert set(entry_point.oracle_sql()) == set(ORACLES)
