"""The driver's contract, and that the rest stands without the text operators."""

import importlib
import os
import sys

import duckdb
import pytest

from tideline.plans import catalog, oracles


def test_entry_and_catalogue():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "change_marks" in o


def test_rest_stands_alone(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("tideline.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tideline.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    e = importlib.import_module("__spark_entry__")
    assert not any(n.startswith("op") or n == "pipeline" for n in e.queries()) and "change_marks" in e.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def _plain(row):
    return repr(tuple(round(x, 8) + 0.0 if isinstance(x, float) else x for x in row))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_agree_with_sql(spark, name):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    rows = catalog.QUERIES[name](spark, d)
    con = duckdb.connect()
    for t in ("events", "embeddings", "documents", "benchmark", "conversations", "labels", "orders"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    names = sorted(rows.columns)
    want = con.sql(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({oracles.SQL[name]})").fetchall()
    assert sorted(map(_plain, want)) == sorted(map(_plain, rows.select(*names).collect()))
