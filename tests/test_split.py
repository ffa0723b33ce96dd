from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickloom.operators import split


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.6, 1.0])
def test_exact_sample_size(imps, fraction):
    got = split.sample_exact(imps, fraction)
    assert got.count() == round(imps.count() * fraction)
    assert got.select("ID").distinct().count() == got.count()


def test_exact_sample_with_tied_places(spark, monkeypatch):
    """Where many keys share a place, the key decides, and the size stays exact."""
    monkeypatch.setattr(split, "hash32", lambda *parts: F.pmod(F.xxhash64(parts[0]), F.lit(5)))
    keys = spark.range(500).select(F.col("id").cast("string").alias("ID"))
    assert split.sample_exact(keys, 0.33).count() == 165


def test_exact_validation_rounds_up(imps):
    flagged = split.mark_validation_exact(imps.limit(101), 0.1)
    assert flagged.where("is_valid").count() == 11


def test_same_under_any_partitioning(imps):
    def places(n):
        df = split.add_fold(split.mark_validation(imps.repartition(n), 0.2), 5)
        return sorted(tuple(r) for r in df.select("ID", "is_valid", "fold").collect())

    assert places(2) == places(8)
    ids = [sorted(r.ID for r in split.sample_exact(imps.repartition(n), 0.3).collect()) for n in (2, 8)]
    assert ids[0] == ids[1]


def test_split_and_folds_are_partitions(imps):
    a, b = split.train_valid_split(imps, 0.2)
    assert a.count() + b.count() == imps.count()
    assert 0.15 < b.count() / imps.count() < 0.25
    sizes = [r["count"] for r in split.add_fold(imps, 5).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > imps.count() / 5 * 0.7


def test_seed_and_purpose_change_the_place(imps):
    valid = split.mark_validation(imps, 0.5).where("is_valid")
    sampled = split.sample(imps, 0.5)
    both = valid.join(sampled.select("ID"), "ID").count()
    assert 0.4 < both / valid.count() < 0.6
