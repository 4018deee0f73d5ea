"""Every test file can be collected beside the others."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

TESTS = Path(__file__).parent


def test_no_test_imports_from_a_conftest():
    marks = ("from " + "conftest", "import " + "conftest")
    found = [p.name for p in TESTS.rglob("*.py") if any(m in p.read_text() for m in marks)]
    assert found == []


def test_module_names_are_used_once():
    names = Counter(p.name for p in TESTS.rglob("*.py") if p.name != "conftest.py")
    assert [n for n, times in names.items() if times > 1] == []
