from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    """A value as text, for comparison of rows across engines."""
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def agree(spark, sf_dir, duck):
    """Compare a query with its SQL, row by row in any order."""

    def check(query, sql):
        df = query(spark, sf_dir)
        cols = sorted(df.columns)
        got = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
        rel = duck.sql(sql)
        names = list(rel.columns)
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = sorted("|".join(plain(r[i]) for i in at) for r in rel.fetchall())
        assert got == want

    return check
