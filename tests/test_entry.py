"""The driver's contract, with or without the removable subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    names = entry.queries()
    assert len(names) >= 79 and set(entry.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the tables aren't here")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["sha", "n", "keep_id"] and df.count() >= 0


def test_without_the_removable_parts(tmp_path):
    for name in ("granary", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split()[1:] == ["False"], done.stderr
