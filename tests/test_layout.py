"""The guard stands without the corpus operators."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "palisade", tmp_path / "palisade", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    queries, oracles = (set(line.split()) for line in out.stdout.splitlines())
    assert "q_behavior_fold" in queries and oracles <= queries
    assert not [n for n in queries if n == "pipeline" or re.match(r"op\d+_", n)]


def test_nothing_else_imports_the_corpus_operators():
    files = [p for p in (ROOT / "palisade").rglob("*.py") if "llm" not in p.relative_to(ROOT / "palisade").parts]
    assert files and not [p for p in files if re.search(r"^\s*(from|import)\s.*\bllm\b", p.read_text(), re.M)]
