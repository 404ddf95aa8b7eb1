import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_every_query_of_the_engine_has_sql():
    from tripleweave import catalogue

    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["corpus_pipeline", "tripleweave.llm"])
def test_entry_works_without_the_optional_subpackage(monkeypatch, missing):
    from tripleweave import catalogue

    for name in list(sys.modules):
        if name == "corpus_pipeline" or name.startswith("tripleweave.llm"):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    monkeypatch.delattr(sys.modules["tripleweave"], "llm", raising=False)
    again = importlib.reload(entry)
    try:
        assert set(again.queries()) == set(catalogue.queries()) == set(again.oracle_sql())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["o", "c", "n"] and df.count() == 123


@pytest.mark.parametrize("name", ["s05_all_predicate_stats", "s08_all_characteristic_sets"])
def test_whole_indexes_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns, rows = [c[0] for c in want.description], sorted(want.fetchall())
    got = entry.queries()[name](spark, sf)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == rows
    said = {p for r in rows for p in (r[0] if name.startswith("s05") else r[1]).split()}
    assert {"<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", *(f"<http://ex.org/{n}>" for n in ("l_order", "event_type", "label", "same_as"))} <= said
