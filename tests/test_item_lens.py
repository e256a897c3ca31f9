"""The lens of order lines joins the tables that are asked for, and those whose keys repeat."""

from __future__ import annotations

import pytest
from conftest import SF

from corvane.sources.lenses import auth_items


def test_only_needed_tables_are_joined(spark):
    some, whole = auth_items(spark, SF, ["seq", "lag", "amount"]), auth_items(spark, SF).select("seq", "amount", "lag")
    assert {f.rsplit("/", 1)[-1] for f in some.inputFiles()} == {"lineitem.parquet", "orders.parquet"}
    assert sorted(map(tuple, some.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


@pytest.mark.parametrize("table", ["orders", "part", "customer", "supplier"])
def test_repeated_keys_repeat_lines(spark, tmp_path, table):
    for name in ("orders", "part", "customer", "supplier", "lineitem"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df.unionByName(df.limit(5)) if name == table else df).write.parquet(f"{tmp_path}/{name}.parquet")
    some = auth_items(spark, str(tmp_path), ["seq", "amount"])
    assert some.count() == auth_items(spark, str(tmp_path)).count() and some.columns == ["seq", "amount"]
