"""The registered queries load without the corpus operators or a library they need."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["regex", "corpus_pipeline", "ledgerloom.llm"])
def test_ledger_queries_stay(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None\n"
            "import __spark_entry__ as e\n"
            "names = set(e.queries())\n"
            "assert 'move_lines' in names and 'pipeline' not in names\n"
            "assert not any(n.startswith('op') and n[2:3].isdigit() for n in names | set(e.oracle_sql()))")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert ("left out" in done.stderr) == (missing == "regex")
