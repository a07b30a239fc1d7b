"""The entry point without the optional text operators."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.modules[{name!r}] = None  # importing it fails
import __spark_entry__ as e
assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""


@pytest.mark.parametrize("name", ["ahocorasick", "tokenizers", "corpus_pipeline", "detlake.llm"])
def test_all_other_queries_stay(name):
    done = subprocess.run([sys.executable, "-c", CODE.format(name=name)], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert "left out" in done.stderr
