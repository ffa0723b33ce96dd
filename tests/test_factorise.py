from __future__ import annotations

from pyspark.sql import functions as F

from clickloom.operators import factorise


def test_slots_are_hashed_once_a_row(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", None), (3, None, None)], "ID long, c string, d string")
    found = factorise.slots(df, ["c", "d"], 2)
    # Both columns share the only slot beside the bias.
    assert [[tuple(e) for e in r.x] for r in found.orderBy("ID").collect()] == [[(0, 1.0), (1, 2.0)]] * 3
    wide = factorise.slots(df, ["c", "d"], 1 << 20)
    assert found.columns == ["ID", "c", "d", "x"]
    assert wide.select("x")._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 2
    assert wide.where(F.size("x") == 3).count() == 3
