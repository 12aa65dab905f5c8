"""The entry points with and without the text operators."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["tallyframe.llm", "public_tokenizers", "corpus_pipeline"])
def test_other_queries_stay_when_a_text_library_is_missing(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; from tallyframe.plans import catalogue as c;"
            "assert list(e.queries()) == list(c.queries()) and e.oracle_sql() == c.oracle_sql(); print(len(e.queries()))")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout.split()[-1]) >= 160, done.stderr[-500:]


def test_every_query_of_the_library_has_its_sql():
    from tallyframe.plans import catalogue

    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
