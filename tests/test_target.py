"""Rates of earlier rows, against a plain version."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickloom.functions.scalar import hash32
from clickloom.operators import lookup, target


def frames(spark):
    values = ["a", "b", None, "a"]
    rows = [(f"r{i}", values[i % 4] if i % 3 else "a", i % 5 if i % 7 else None, float((i * i) % 3 == 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "ID string, u string, w int, label double")
    return df.where("ID < 'r7'"), df.where("ID >= 'r7'").drop("label")


def plain(train, weight):
    order = {r.ID: r.h for r in train.select("ID", hash32(F.col("ID"), F.lit("order")).alias("h")).collect()}
    rows = sorted(train.collect(), key=lambda r: (order[r.ID], r.ID))
    mean = sum(r.label for r in rows) / len(rows)
    seen, out = {}, {}
    for r in rows:
        for name, key in (("rate_u", ("u", r.u)), ("rate_w", ("w", r.w)), ("rate_u_w", (r.u, r.w))):
            hits, n = seen.get(key, (0.0, 0))
            out[r.ID, name] = (hits + weight * mean) / (n + weight)
            seen[key] = (hits + r.label, n + 1)
    return out, seen, mean


@pytest.mark.parametrize("bucket_rows", [5, 1_000_000])
def test_rates_of_earlier_rows(spark, bucket_rows):
    train, other = frames(spark)
    combos = target.combinations_of(["u", "w"])
    assert combos == [("u",), ("w",), ("u", "w")]
    got, (rest,) = target.ordered_rates(train, [other], combos, weight=3.0, bucket_rows=bucket_rows)
    want, seen, mean = plain(train, 3.0)
    names = [target.rate_name(c) for c in combos]
    assert got.columns == [*train.columns, *names] and got.count() == train.count()
    for r in got.collect():
        for name in names:
            assert r[name] == pytest.approx(want[r.ID, name], abs=1e-12)
    for r in rest.collect():
        for name, key in zip(names, (("u", r.u), ("w", r.w), (r.u, r.w))):
            hits, n = seen.get(key, (0.0, 0))
            assert r[name] == pytest.approx((hits + 3.0 * mean) / (n + 3.0), abs=1e-12)


def test_own_label_never_enters(spark):
    train, _ = frames(spark)
    combos = target.combinations_of(["u", "w"])
    names = ["ID", *map(target.rate_name, combos)]
    # The overall rate is kept the same by a second row that is flipped the other way.
    flipped = train.withColumn("label", F.when(F.col("ID").isin("r1", "r3"), 1.0 - F.col("label")).otherwise(F.col("label")))
    labels = {r.ID: r.label for r in train.where("ID IN ('r1', 'r3')").collect()}
    assert sorted(labels.values()) == [0.0, 1.0]
    before = {r.ID: tuple(r) for r in target.ordered_rates(train, [], combos)[0].select(*names).collect()}
    after = {r.ID: tuple(r) for r in target.ordered_rates(flipped, [], combos)[0].select(*names).collect()}
    order = {r.ID: r.h for r in train.select("ID", hash32(F.col("ID"), F.lit("order")).alias("h")).collect()}
    first = min(("r1", "r3"), key=order.get)
    assert before[first] == after[first]
    # Rows before both are as they were, some later ones are not.
    assert all(before[i] == after[i] for i in order if order[i] < order[first])
    assert any(before[i] != after[i] for i in order)


def test_empty_tables(spark):
    train, other = frames(spark)
    none, (rest,) = target.ordered_rates(train.limit(0), [other], [("u",)])
    assert none.count() == 0 and {r.rate_u for r in rest.collect()} == {0.0}


def test_values_of_other_tables_meet_by_a_join_beyond_the_limit(spark, monkeypatch):
    rows = [(str(i), float(i % 3 == 0), f"a{i % 4}", f"b{i % 29}") for i in range(120)]
    train = spark.createDataFrame(rows, "ID string, label double, a string, b string")
    combos = target.combinations_of(["a", "b"])

    def rates():
        return sorted(map(tuple, target.ordered_rates(train, [train.drop("label")], combos)[1][0].collect()))

    assert target.LIMITS.broadcast_bytes <= 8 << 20
    broadcast = rates()
    monkeypatch.setattr(target, "LIMITS", target.JoinLimits(broadcast_bytes=0))
    assert rates() == broadcast


def test_no_table_that_grows_with_the_rows_is_broadcast(spark, imps):
    """Their files are small, and a broadcast table is built in the driver."""
    rows = imps.select("ID", F.col("click").cast("double").alias("label"), "category", "devid")
    train, (other,) = target.ordered_rates(rows, [rows], target.combinations_of(["category", "devid"]), bucket_rows=100)
    plans = [t._jdf.queryExecution().executedPlan().toString() for t in (train, other)]
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
    # The table of values was found to be small; the rates of the rows are not looked up so.
    assert "SortMergeJoin" in plans[1] and plans[1].count("BroadcastHashJoin") <= 1


def test_a_table_beyond_the_limit_is_not_broadcast(spark):
    table = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    df = spark.range(200).select((F.col("id") % 60).alias("k"))
    found = lookup.lookup_join(df, table, ["k"], "left", limits=lookup.JoinLimits(broadcast_bytes=0))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert found.where("v = 2 * k").count() == 170 and found.where("v IS NULL").count() == 30
