"""Run one of the whole flows: ``spark-submit run.py boosted --train … --test … --out …``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from clickloom.models import trees
from clickloom.models.boosting import Boosting
from clickloom.models.grow import Growth
from clickloom.operators import ftrl, prep
from clickloom.plans import flows
from clickloom.session import remove_work

# Columns an online run hashes.
HASHED = ["siteid", "offerid", "category", "merchant", "countrycode", "browserid", "devid", "tweekday", "thour"]
FILLS = {"none": prep.FILL_NONE, "desktop": prep.FILL_DESKTOP}


def boost(a: argparse.Namespace) -> trees.Boost:
    return trees.Boost(a.rounds, a.depth, a.step, a.row_share, a.feature_share)


def boosting_settings(a: argparse.Namespace) -> Boosting:
    share = 1.0 if a.feature_share == "all" else float(a.feature_share)
    return Boosting(a.rounds, a.step, growth=Growth(a.depth, a.leaves, row_share=a.row_share, feature_share=share), patience=a.patience)


def online(spark: SparkSession, inputs: flows.Inputs, a: argparse.Namespace) -> flows.Run:
    p = ftrl.Ftrl(a.alpha, a.beta, a.l1, a.l2, a.size)
    return flows.online(
        spark, inputs, HASHED, p, a.epochs, a.batches, a.interactions, a.holdout_every, a.holdout_after
    )


RUNS = {
    "boosted": lambda s, i, a: flows.boosted(s, i, boost(a)),
    "early_stop": lambda s, i, a: flows.boosted_early_stop(s, i, boosting_settings(a))[0],
    "categorical": lambda s, i, a: flows.categorical(s, i, boost(a)),
    "tuned": lambda s, i, a: flows.tuned(s, i, boost(a), a.depths, a.steps, a.folds),
    "perceptron": lambda s, i, a: flows.perceptron(s, i),
    "perceptron_folds": lambda s, i, a: flows.perceptron_folds(s, i),
    "factorisation_machine": lambda s, i, a: flows.factorisation_machine(s, i),
    "bayes": lambda s, i, a: flows.bayes(s, i),
    "best_candidate": lambda s, i, a: flows.best_candidate(s, i),
    "blended": lambda s, i, a: flows.blended(s, i, boost(a)),
    "online": online,
    "merged": lambda s, i, a: flows.merged(s, a.stacked, a.boosted, i.out, tuple(a.weights)),
}


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("run", choices=sorted(RUNS))
    args.add_argument("--out", required=True)
    args.add_argument("--train", help="all runs but merged")
    args.add_argument("--test", help="all runs but merged")
    args.add_argument("--counts", type=int, default=6, choices=[0, 3, 6, 15, 19])
    args.add_argument("--sample", type=float, default=1.0)
    args.add_argument("--valid", type=float, default=0.1)
    args.add_argument("--scaled", action="store_true")
    args.add_argument("--unique-ids", action="store_true", help="no ID is repeated, so counts by ID need no shuffle")
    args.add_argument("--save", help="folder for the fitted model")
    args.add_argument("--fill", choices=sorted(FILLS), default="none")
    trees_ = args.add_argument_group("boosted trees")
    trees_.add_argument("--rounds", type=int, default=20)
    trees_.add_argument("--depth", type=int, default=5)
    trees_.add_argument("--step", type=float, default=0.1)
    trees_.add_argument("--row-share", type=float, default=1.0)
    trees_.add_argument("--feature-share", default="all")
    trees_.add_argument("--patience", type=int, default=20)
    trees_.add_argument("--leaves", type=int, help="grow trees of early_stop best first to so many leaves")
    trees_.add_argument("--depths", type=int, nargs="+", default=[4, 6])
    trees_.add_argument("--steps", type=float, nargs="+", default=[0.05, 0.1])
    trees_.add_argument("--folds", type=int, default=5)
    online_ = args.add_argument_group("online")
    online_.add_argument("--alpha", type=float, default=0.1)
    online_.add_argument("--beta", type=float, default=0.1)
    online_.add_argument("--l1", type=float, default=0.0)
    online_.add_argument("--l2", type=float, default=0.0)
    online_.add_argument("--size", type=int, default=2**20)
    online_.add_argument("--epochs", type=int, default=5)
    online_.add_argument("--batches", type=int, help="number of batches; by default they have 100,000 rows each")
    online_.add_argument("--interactions", action="store_true")
    online_.add_argument("--holdout-every", type=int)
    online_.add_argument("--holdout-after")
    merged_ = args.add_argument_group("merged")
    merged_.add_argument("--stacked")
    merged_.add_argument("--boosted")
    merged_.add_argument("--weights", type=float, nargs=2, default=[0.2855, 0.7145])
    return args


def main() -> None:
    a = parser().parse_args()
    spark = SparkSession.builder.appName(f"clickloom {a.run}").getOrCreate()
    inputs = flows.Inputs(a.train, a.test, a.out, a.counts, a.sample, a.valid, a.scaled, a.unique_ids, a.save, FILLS[a.fill])
    print(RUNS[a.run](spark, inputs, a))
    remove_work(spark)


if __name__ == "__main__":
    main()
