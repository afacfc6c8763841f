"""The SQL twins of the training-data queries, on the smallest tables."""

import duckdb
import pytest

from plotline.llm import queries as Q
from plotline.sources.readers import DRIVER_TABLES
from tests.conftest import SF_SMALL
from tools.compare import compare_rows, type_differences


#: the SQL's running number is a narrower integer than the query's; values are equal
KNOWN = {"op10_tool_calls": {"step": ("BIGINT", "INTEGER")}}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_oracle_parity(spark, duck, name):
    sdf = Q.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(Q.ORACLE_SQL[name])
    assert compare_rows(sdf.columns, rows, [d[0] for d in res.description], res.fetchall()) is None
    assert type_differences(sdf.schema, res.description) == KNOWN.get(name, {})
