"""The driver's contract, with and without the subpackage of training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "text", "score"]
    assert df.count() >= 0


def test_names():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names


def test_imports_without_llm(tmp_path):
    shutil.copytree(ROOT / "corvane", tmp_path / "corvane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(x.startswith('op') or x == 'pipeline' for x in q), q; print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) > 80


def test_nothing_else_imports_llm():
    for f in (ROOT / "corvane").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "corvane.llm" not in f.read_text(), f
