"""The registry: with and without the training-data package."""

import ast
import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "region" in df.columns


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_registry_without_the_training_data_package(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pause_regions' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql(); print('fine')"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, timeout=120)
    assert ran.stdout.strip() == "fine", ran.stderr


def test_no_name_is_defined_twice_in_a_module():
    """A later definition would silently take the place of the one that earlier queries call."""
    for path in sorted((Path(ROOT) / "metrum").rglob("*.py")):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        assert sorted(set(names)) == sorted(names), path
