"""The driver's entry module, with and without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(root: Path) -> list[str]:
    code = "import __spark_entry__ as e; print(*e.queries())"
    return subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True, timeout=120).stdout.split()


def test_imports_without_the_corpus_operators(tmp_path):
    bare = tmp_path / "bare"
    shutil.copytree(ROOT / "claimloom", bare / "claimloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", bare)
    found = names(bare)
    assert "evidence_derive" in found and not [n for n in found if n.startswith("op")] and "pipeline" not in found


def test_nothing_else_imports_the_corpus_operators():
    for source in (ROOT / "claimloom").rglob("*.py"):
        if "llm" not in source.relative_to(ROOT).parts:
            assert "llm import" not in source.read_text() and "import llm" not in source.read_text(), source
