import os
import subprocess
import sys

import pytest

from cellweave.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import differences

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], FOLDER) == ""


@needs_data
def test_lineage_queries(spark):
    nodes, labels = QUERIES["track_nodes"](spark, FOLDER), QUERIES["branch_raster"](spark, FOLDER)
    assert nodes.count() == QUERIES["object_ids"](spark, FOLDER).count() and nodes.agg({"area_cells": "sum"}).first()[0] == labels.count()
    assert not any(r.failures for r in QUERIES["quality_checks"](spark, FOLDER).collect())


def test_entry_without_the_llm_part():
    """The rest works, and finds its queries, where neither folder nor pipeline is there."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.splitlines()
    assert set(out[-2].split()) == set(QUERIES) and set(out[-1].split()) == set(ORACLE_SQL)


def test_nothing_else_imports_the_llm_part():
    for top, _, names in os.walk(f"{ROOT}/cellweave"):
        if "llm" in top.split(os.sep):
            continue
        for n in names:
            if n.endswith(".py"):
                assert "llm" not in open(f"{top}/{n}").read()
