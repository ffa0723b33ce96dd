from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from clickloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def imps(spark):
    from clickloom.session import materialize
    from clickloom.sources import samples

    return materialize(samples.impressions(spark, SMALL), "impressions")


@pytest.fixture(scope="session")
def learnable(spark):
    """Impressions whose label follows category and device, with 10% flipped."""
    from pyspark.sql import functions as F

    from clickloom.functions.scalar import unit_hash
    from clickloom.session import materialize
    from clickloom.sources import samples

    imps = samples.impressions(spark, MEDIUM)
    rule = (F.col("category") > 25) == F.col("devid").isin("Mobile", "Desktop")
    rule = F.coalesce(rule, F.lit(False))
    flip = unit_hash(F.col("ID"), seed="flip") < 0.1
    return materialize(imps.withColumn("click", (rule != flip).cast("int")), "learnable")
