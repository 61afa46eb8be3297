"""Every registered query of the catalog against its SQL, or for a stable schema and rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from prismatic.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(frame: pd.DataFrame) -> pd.DataFrame:
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and np.isnan(v):
            return "null"
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 6))
        return str(int(v)) if isinstance(v, (int, np.integer, bool, np.bool_)) else str(v)

    return frame[sorted(frame)].map(plain).sort_values(sorted(frame)).reset_index(drop=True)


def whole(frame: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers alike, whether or not nulls made them doubles."""
    for c in frame:
        if pd.api.types.is_numeric_dtype(frame[c]) and not pd.api.types.is_bool_dtype(frame[c]):
            frame[c] = frame[c].astype("float64")
    return frame


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, data, name):
    found = QUERIES[name](spark, data).toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    expected = sql.execute(ORACLES[name]).df()
    assert sorted(found) == sorted(expected)
    pd.testing.assert_frame_equal(comparable(whole(found)), comparable(whole(expected)))
