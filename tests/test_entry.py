"""The entry point imports without a session, and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'screener' in q; print(any(n.startswith('op') for n in q))"


def run(folder):
    return subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120)


def test_imports_without_a_session():
    out = run(ROOT)
    assert out.returncode == 0, out.stderr


def test_imports_without_the_operators(tmp_path):
    shutil.copytree(ROOT / "barline", tmp_path / "barline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):  # the pipeline may stay behind
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    out = run(tmp_path)
    assert out.returncode == 0 and out.stdout.strip() == "False", out.stderr


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).take(1)) == 1
