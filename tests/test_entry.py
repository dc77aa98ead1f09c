import ast
from pathlib import Path

import __spark_entry__ as entry

TOP = Path(__file__).resolve().parent.parent


def test_names_and_sql():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 110 and len(s) >= 95


def test_nothing_outside_imports_the_llm_folder():
    for path in (TOP / "marginalia").rglob("*.py"):
        if "llm" in path.relative_to(TOP / "marginalia").parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["a", "b"]
