"""The rest of the library without the llm subpackage."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).parents[1]


def test_nothing_else_imports_llm():
    for path in (ROOT / "veilspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", path.read_text(), re.M), path


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "veilspark", tmp_path / "veilspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; from veilspark.plans.queries import QUERIES, SQL; assert e.queries() == QUERIES and e.oracle_sql() == SQL; print(len(QUERIES))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) >= 50, done.stderr


@pytest.mark.skipif(not (ROOT / "veilspark" / "llm").exists(), reason="without the subpackage")
def test_all_queries_are_registered():
    """The guard must not hide a broken module."""
    names = set(entry.queries())
    assert "pipeline" in names and {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 14)}
