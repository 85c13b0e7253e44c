"""The registry with and without the corpus subpackage."""

import importlib
import sys

import pytest

import __spark_entry__ as entry
from adoptlens.plans import registry
from adoptlens.session import cut_lineage, scratch, shared_root


class Missing:
    """Finds no module of a given name, as if its files were gone."""

    def __init__(self, name):
        self.name = name

    def find_spec(self, name, path=None, target=None):
        if name == self.name or name.startswith(self.name + "."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)


@pytest.mark.parametrize("name", ["adoptlens.llm", "corpus_pipeline", "numpy_of_another_name"])
def test_the_rest_works_without_the_corpus_queries(monkeypatch, name):
    for known in [m for m in sys.modules if m.startswith("adoptlens.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, known)
    monkeypatch.setattr(sys, "meta_path", [Missing(name), *sys.meta_path])
    importlib.invalidate_caches()
    found = entry.queries()
    assert set(registry.queries()) <= set(found)
    assert set(entry.oracle_sql()) <= set(found)
    if name != "numpy_of_another_name":
        assert set(registry.queries()) == set(found)


def test_another_missing_module_is_an_error(monkeypatch):
    for known in [m for m in sys.modules if m.startswith("adoptlens.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, known)
    try:
        importlib.util.find_spec("adoptlens.llm.common")
    except ModuleNotFoundError:
        pytest.skip("without the corpus subpackage")
    monkeypatch.setattr(sys, "meta_path", [Missing("adoptlens.llm.common"), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_scratch_leaves_nothing_behind(spark, tmp_path):
    with scratch(spark):
        table = cut_lineage(spark.range(10))
        path = table.inputFiles()[0]
        assert table.count() == 10 and path.split(":")[-1].lstrip("/").startswith(shared_root(spark).lstrip("/"))
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
