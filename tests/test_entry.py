"""The driver's entry module without the text operators: the other queries stay."""

import os
import shutil
import subprocess
import sys

import pytest

from marlspark import queries as core

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(n.startswith("op") or n == "pipeline" for n in [*e.queries(), *e.oracle_sql()]))
"""


@pytest.mark.parametrize("gone", [("marlspark/llm", "tests/llm"), ("marlspark/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_text_operators(tmp_path, gone):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        path = tree / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    found = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tree, env=os.environ | {"PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0, found.stderr
    assert found.stdout.split() == [str(len(core.QUERIES)), str(len(core.SQL)), "False"]
