"""The driver contract without the corpus operators."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import sys
for name in {hidden!r}:
    sys.modules[name] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert names >= {{"k2_margin_series", "a1_csv_uploads"}}
assert set(entry.oracle_sql()) <= names
print(sum(n.startswith("op") or n == "pipeline" for n in names))
"""


@pytest.mark.parametrize("hidden", [["corpus_pipeline"], ["ledgerspark.llm"], ["corpus_pipeline", "ledgerspark.llm"]])
def test_entry_without_corpus_operators(hidden):
    run = subprocess.run(
        [sys.executable, "-c", PROBE.format(hidden=hidden)], cwd=ROOT, capture_output=True, text=True
    )
    assert (run.returncode, run.stdout.strip()) == (0, "0"), run.stderr


def test_other_faults_show():
    run = subprocess.run(
        [sys.executable, "-c", PROBE.format(hidden=["numpy"])], cwd=ROOT, capture_output=True, text=True
    )
    assert run.returncode != 0 and "numpy" in run.stderr
