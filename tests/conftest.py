import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    return duckdb


def duck_views(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    found = con.sql(sql)
    cols = sorted(found.columns)
    at = [found.columns.index(c) for c in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.fixture(scope="session")
def compare(spark):
    def check(name, sf_dir):
        import __spark_entry__ as entry

        assert rows_of(entry.queries()[name](spark, sf_dir)) == duck_rows(duck_views(sf_dir), entry.oracle_sql()[name])

    return check
