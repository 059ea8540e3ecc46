import os

import pytest

from cellweave.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import differences

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def lost_frame(tmp_path_factory):
    """Events of which every cell of two frames has a bad one."""
    import duckdb

    folder = str(tmp_path_factory.mktemp("lost"))
    bad = "ts: TIMESTAMP '2024-01-01 00:10:00' + to_hours(6 * CAST(t AS INTEGER)), user_id: y, value: x + 0.5, event_type: 'error'"
    replaced = ", ".join(f"{v} AS {k}" for k, v in (one.split(": ", 1) for one in bad.split(", ")))
    one = f"(SELECT * FROM '{FOLDER}/events.parquet' LIMIT 1)"
    duckdb.sql(f"COPY (SELECT * FROM '{FOLDER}/events.parquet' UNION ALL SELECT e.* REPLACE ({replaced}) FROM {one} e, (VALUES (7), (50)) f(t), range(12) a(y), range(12) b(x)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["resumed_nodes", "series_increments"])
def test_frames_missing_as_a_whole(spark, lost_frame, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], lost_frame) == ""
