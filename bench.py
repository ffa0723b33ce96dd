"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from clickloom.plans.catalog import QUERIES  # noqa: E402
from clickloom.plans.learning import forget_features  # noqa: E402
from clickloom.session import build_session  # noqa: E402

HEADLINE = [
    "null_fraction",
    "pair_count",
    "count_features_3",
    "count_features_6",
    "count_features_15",
    "count_features_19",
    "label_encode",
    "standardize",
    "hash_interactions",
    "corr_matrix",
    "sample_exact",
    "global_ordinal",
    "roc_auc",
    "average_precision",
    "blend_sweep",
    "linear_score",
    "fm_score",
    "fm_score_pairwise",
    "bernoulli_nb",
    "ftrl_round",
    "gbt_score",
    "rf_score",
    "stack_fit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # Start the JVM's code paths once, outside the clock.
    QUERIES["profile_shape"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        # Each query pays for its own features.
        forget_features()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
