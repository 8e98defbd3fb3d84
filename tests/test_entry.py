import __spark_entry__ as entry


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


def test_nothing_imports_the_llm_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in [*(root / "sparquill").rglob("*.py"), root / "bench.py"]:
        if "llm" not in p.relative_to(root).parts:
            assert "sparquill.llm" not in p.read_text(), p


def test_the_core_queries_stay_where_those_of_llm_cannot_be_imported(monkeypatch, recwarn):
    import importlib

    whole, real = set(entry.queries()), importlib.import_module

    def broken(name, *args):
        if name == "sparquill.llm.plans":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *args)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    left = set(entry.queries())
    assert left and not any(n[0] == "p" and n[1].isdigit() and n[1] != "5" for n in left) and left <= whole
