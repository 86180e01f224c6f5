"""Every registered query of the library against its DuckDB equivalent."""

import math
from pathlib import Path

import duckdb
import pytest

from skillgraph.plans import checks, data, evaluation, graphs  # noqa: F401
from skillgraph.plans.fixtures import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF.iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or hasattr(value, "dtype") and value.dtype == bool:
        return bool(value)
    return round(float(value), 6) + 0.0 if isinstance(value, (int, float)) or hasattr(value, "dtype") else value


def table(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, str(SF)).toPandas()
    assert len(found)  # equality of two empty results would show nothing
    if name not in ORACLES:
        return
    assert table(found) == table(duck.sql(ORACLES[name]).df())
