"""The rest of the library stands without the operators for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert not (copy / "lexloom" / "llm").exists() and not (copy / "tests" / "llm").exists()
    said = "import importlib, pkgutil, lexloom, __spark_entry__ as e; [importlib.import_module(m.name) for m in pkgutil.walk_packages(lexloom.__path__, 'lexloom.')]; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    got = subprocess.run([sys.executable, "-c", said], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
    n, own, covered = got.stdout.split()
    assert int(n) > 190 and own == "0" and covered == "True", got.stderr
