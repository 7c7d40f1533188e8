"""The driver's contract, and that the library stands without the training-data operators."""

import ast
import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import pytest

REPO = Path(entry.__file__).resolve().parent


def test_entry(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and "odd_score" in got.columns


@pytest.mark.parametrize("name", sorted(entry.reference.QUERIES))
def test_reference_queries_run(spark, name):
    frame = entry.queries()[name](spark, entry.DATA)
    assert frame.columns and len(set(frame.columns)) == len(frame.columns)
    assert frame.limit(5).collect() is not None


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_subpackage():
    for p in (REPO / "roadloom").rglob("*.py"):
        if "llm" in p.relative_to(REPO).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), p


def test_entry_without_llm(tmp_path):
    for p in ("roadloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(REPO / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "roadloom/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'visit_packets' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
