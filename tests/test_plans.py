"""Every registered plan against its SQL on the smallest tables."""

import importlib.util
import sys
from pathlib import Path

import pytest

from marlstone.plans import registry

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"

spec = importlib.util.spec_from_file_location("compare", ROOT / "tools" / "compare.py")
compare = importlib.util.module_from_spec(spec)
sys.modules["compare"] = compare
spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, con, name):
    said = compare.compare(spark, con, name, registry.QUERIES[name], registry.SQL[name], SF)
    assert said.startswith("ok"), said


#: Plans that SQL cannot express, and the tests that hold them to plain Python.
ELSEWHERE = {
    "test_fuzzy": {"fuzzy_name", "fuzzy_person", "fuzzy_keyword", "name_score", "indel_ratio"},
    "test_recommendation": {"kmeans_interests", "weighted_interleave", "mmr_diversify", "profile_content", "profile_hybrid", "als_residual", "ridge_fold_in", "recommend_cascade"},
    "test_evaluation": {"search_dispatch", "encode_documents"},
}


def test_plans_without_sql_are_tested_elsewhere():
    assert set().union(*ELSEWHERE.values()) == registry.QUERIES.keys() - registry.SQL.keys()
    for module, names in ELSEWHERE.items():
        text = (ROOT / "tests" / f"{module}.py").read_text()
        assert [name for name in names if f'"{name}"' not in text] == [], module


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert entry.oracle_sql().keys() <= entry.queries().keys()
