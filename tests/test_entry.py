"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('tidemark.llm'):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert not [n for n in e.queries() if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in e.queries()
assert e.queries() and set(e.oracle_sql()) <= set(e.queries())
"""


def test_without_llm():
    subprocess.run([sys.executable, "-c", BLOCK], cwd=ROOT, check=True)


def test_nothing_else_imports_llm():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
