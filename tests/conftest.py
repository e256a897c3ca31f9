from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    """Rows as sorted tuples of plain values, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order) for r in data]
    return sorted(columns), sorted(plain, key=lambda r: [(v is None, str(v)) for v in r])


def same(spark_df, relation):
    a = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    b = rows([d[0] for d in relation.description], relation.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1], strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float)) or type(v).__name__ == "Decimal") and u is not None and abs(float(u) - float(v)) <= 1e-9 * max(1, abs(float(v))), (x, y)
