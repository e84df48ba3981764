"""A query of every stage against its DuckDB SQL, and the driver contract."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from tributary.plans.queries import ORACLE, QUERIES

# The whole set at sf0.01 is compared by check_oracle.py; these cover every stage on the smallest tables.
SHOWN = [
    "failure_code",
    "canonicalize",
    "duplicate_report",
    "replay_quarantine",
    "feature_vector",
    "resolve_fallback",
    "decide",
    "alert_rows",
    "audit_trail",
    "event_summary",
    "patient_timeline",
    "overview",
    "model_panel",
    "histogram_quantile",
    "quota_flag",
]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", SHOWN)
def test_query_equals_sql(spark, sf, con, name):
    count, problem = compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name])
    assert not problem
    assert count > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # These show learned numbers, which SQL cannot know; see tests/test_models.py.
    trained = {"train_isolation_forest", "score_isolation_forest", "train_risk_model", "trained_alerts"}
    assert set(QUERIES) - set(ORACLE) == trained  # the document queries have tests of their own
    assert set(QUERIES) <= set(entry.queries()) and ORACLE.items() <= entry.oracle_sql().items()
    assert entry.entry(spark).count() > 0


def test_entry_without_the_document_operators():
    """The entry imports and has this package's queries when the document operators and the corpus pipeline are not there."""
    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "tributary.llm" or name.startswith("tributary.llm.") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
from tributary.plans.queries import ORACLE, QUERIES
assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE)
print(len(QUERIES))
"""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root)
    assert done.stdout.strip() == str(len(QUERIES)), done.stderr
