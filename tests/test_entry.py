"""What the driver's contract file forgives: a missing optional part, nothing else."""

import sys
import types

import pytest

import __spark_entry__ as entry


def test_without_the_optional_parts(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = entry.queries()
    assert "pipeline" not in names and not any(n.startswith("op1_") for n in names)
    assert "gbt_grid_search" in names and "end_to_end_report" in entry.oracle_sql()


def test_a_fault_inside_is_not_swallowed(monkeypatch):
    class Broken(types.ModuleType):
        def __getattr__(self, name):
            raise ModuleNotFoundError("broken", name="lexis.no_such_part")

    monkeypatch.setitem(sys.modules, "lexis.llm", types.ModuleType("lexis.llm"))
    monkeypatch.setitem(sys.modules, "lexis.llm.queries", Broken("lexis.llm.queries"))
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
