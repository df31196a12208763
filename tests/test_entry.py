import sys

import pytest

import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", [("shelfmark.llm", "corpus_pipeline"), ("xxhash",)])
def test_entry_without_the_llm_package(monkeypatch, missing):
    """The other queries stay when the package and the pipeline are gone, or need what is not installed."""
    for m in [m for m in sys.modules if m.startswith("shelfmark.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    for m in missing:
        monkeypatch.setitem(sys.modules, m, None)  # importing it fails
    names = set(entry.queries())
    assert "dup_exact_groups" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert not set(entry.oracle_sql()) - names
