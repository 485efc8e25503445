"""The driver entry without parts of the library."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["public_tokenizers", "corpus_pipeline", "vigilframe.llm"])
def test_what_cannot_be_imported_takes_nothing_else_away(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(set(e.queries()) - {{'pipeline'}}), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) >= 190 and int(said[1]) >= 186
