"""The whole tree of tests collects, with the corpus operators' tests and without them."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("more", [[], ["--ignore=tests/llm"]])
def test_all_modules_collect(more):
    call = [sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider", *more]
    found = subprocess.run(call, cwd=ROOT, capture_output=True, text=True)
    assert found.returncode == 0, found.stdout[-2000:]
