"""The driver's contract, with and without the corpus subpackage."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_sql_is_text():
    import __spark_entry__ as entry

    assert all(isinstance(x, str) for x in entry.oracle_sql().values())


def test_the_rest_works_without_the_corpus_subpackage(tmp_path):
    for p in REPO.iterdir():
        if p.name not in ("cuesheet", "corpus_pipeline.py", "tests") and not p.name.startswith("."):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "cuesheet").mkdir()
    for p in (REPO / "cuesheet").iterdir():
        if p.name != "llm":
            (tmp_path / "cuesheet" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
