"""The entry holds without the training-data subpackage, whatever of it is gone."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e, stratagraph.catalog as c; q = e.queries(); assert set(c.queries()) <= set(q); e.oracle_sql(); print(len(q) - len(c.queries()))"


@pytest.mark.parametrize("gone", [("stratagraph/llm",), ("stratagraph/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_deletion_leaves_the_rest(tmp_path, gone):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        shutil.rmtree(at / name, ignore_errors=True)
        (at / name).unlink(missing_ok=True) if (at / name).is_file() else None
    made = subprocess.run([sys.executable, "-c", COUNT], cwd=at, capture_output=True, text=True, timeout=120)
    assert made.returncode == 0, made.stderr
    if "stratagraph/llm" in gone:
        assert int(made.stdout) == 0
