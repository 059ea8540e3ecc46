import os
import re

import pytest

from cellweave.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    1: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    2: {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    3: {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    5: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    6: {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    7: {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    8: {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    9: {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    11: {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    12: {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    13: {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
}
TABLE = {2: "pages", 3: "conversations", 7: "embeddings"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], FOLDER) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    n = int(re.match(r"op(\d+)_", name)[1])
    df = QUERIES[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    assert kinds.items() >= COLUMNS.get(n, {}).items()
    rows = df.count()
    if n in COLUMNS:
        table = spark.read.parquet(f"{FOLDER}/{TABLE.get(n, 'documents')}.parquet")
        want = table.select("conv_id").distinct().count() + 1 if n == 3 else table.count()
        assert rows == want


def test_all_thirteen_are_there():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
