"""The driver contract holds with and without the optional subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_contract():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names
    assert len(names) > 60


def test_imports_without_the_optional_parts(tmp_path):
    import shutil

    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_imports_the_optional_parts():
    for file in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in file.parts:
            assert "tidemark.llm" not in file.read_text(), file


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and rows[0]["reason"]
