"""The guard of the entry module: what the training-data operators need may be missing."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from weftgraph.plans import registry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("hidden", ["zstandard", "weftgraph.llm", "corpus_pipeline"])
def test_hidden_modules(hidden):
    """With a module hidden, the library's own queries are all there, and so is their SQL."""
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, len(set(o) - set(q)))"
    n, sql, pipeline, more = subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True, check=True).stdout.split()
    own, own_sql = registry.queries(), registry.oracle_sql()
    assert int(n) >= len(own) and int(sql) >= len(own_sql) and pipeline == "False" and more == "0"
    assert hidden == "corpus_pipeline" or int(n) == len(own)


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.queries()) <= set(entry.queries())
