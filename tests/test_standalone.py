"""The library without the corpus operators: their folders, and the pipeline's file or not, are deleted from a copy."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names, sql = set(e.queries()), set(e.oracle_sql())
assert len(names) > 80 and sql <= names, len(names)
assert not [n for n in names if n.startswith("op") and n[2:3].isdigit()] and "pipeline" not in names
import riskspark.sources.files, riskspark.streaming.monitor, riskspark.operators.model
"""


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_corpus_operators(tmp_path, pipeline):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse", *([] if pipeline else ["corpus_pipeline.py"])))
    assert not (at / "riskspark" / "llm").exists() and (at / "corpus_pipeline.py").exists() == pipeline
    done = subprocess.run([sys.executable, "-c", CODE], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    listed = subprocess.run([sys.executable, "-m", "pytest", "-q", "--collect-only", "tests"], cwd=at, env=os.environ | {"PYTHONPATH": str(at)}, capture_output=True, text=True, timeout=120)
    assert listed.returncode == 0, listed.stdout
