"""The driver's contract holds with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(__spark_entry__.queries()) > 60


def test_imports_without_llm(tmp_path):
    for name in os.listdir(ROOT):
        if name in ("tallyworks", "__spark_entry__.py"):
            target = tmp_path / name
            shutil.copytree(f"{ROOT}/{name}", target, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(f"{ROOT}/{name}") else shutil.copy(f"{ROOT}/{name}", target)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
