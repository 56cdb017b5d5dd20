"""The entry module imports with and without the folder of training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder):
    said = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return [line.split() for line in said.stdout.splitlines()]


@pytest.mark.parametrize("gone", [["tidewater/llm", "tests/llm"], ["tidewater/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_import_without(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", "*.json"))
    for name in gone:
        shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    queries, oracles = listed(copy)
    assert set(oracles) <= set(queries) and "q01_hot_items" in queries
    assert any(q.startswith("op") for q in queries) == (copy / "tidewater/llm/queries.py").exists()
    assert "pipeline" not in queries
