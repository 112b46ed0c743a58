"""The driver contract: entry() runs on sf0.001; every query has a name-aligned twin or is rows-only."""

import __spark_entry__ as entry_mod


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["check_id", "sub_key", "similarity", "error", "rank"]
    assert df.count() == 200


def test_oracle_keys_are_queries():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40 and len(o) >= 30


def test_entry_loads_without_the_optional_folders(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("resemble.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "resemble.llm", None)
    assert entry_mod._optional() == ({}, {})
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and "cosine_one_vs_many" in q and not any(n.startswith("op") or n == "pipeline" for n in q)
