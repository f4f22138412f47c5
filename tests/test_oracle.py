"""Every registered query against its SQL on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry_point  # noqa: E402
from check_oracle import compare  # noqa: E402
from sitewright import plans  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
#: No rows at the smallest size (too few positions in a row); any other empty result is a failure.
EMPTY = {"greedy_windows", "offset_submatrix", "sliding_windows"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def test_oracle_keys_are_registered_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok or (note.endswith("EMPTY") and name in EMPTY), note
