"""Queries over metrics, training logs and blends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import ensemble, logs, metrics, split
from clickloom.plans.registry import IMP, LOGS, LONG_SCORES, SCORED, hash32_sql, query, rounded
from clickloom.session import new_path
from clickloom.sources import readers, samples, writers


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.with_scores(samples.impressions(spark, sf_dir))


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir).select("ID", "click", "score_a", "score_b")
    return df.unpivot(["ID", "click"], ["score_a", "score_b"], "model", "score")


LADDER = """steps AS (SELECT model, score, sum(click) AS p, sum(1 - click) AS n FROM long_scores GROUP BY model, score),
ladder AS (SELECT model, score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM steps
  WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


@query(
    "roc_auc",
    f"""WITH {LONG_SCORES}, {LADDER} SELECT model,
    round(sum(n * (tp - p / CAST(2 AS DOUBLE))) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS auc FROM ladder GROUP BY model""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(long_scores(spark, sf_dir), "score", "click", ("model",)), "auc")


@query(
    "roc_trapezoid",
    f"""WITH {LONG_SCORES}, {LADDER}, t AS (SELECT model, fp, tp,
      lag(fp, 1, 0) OVER w AS fp0, lag(tp, 1, 0) OVER w AS tp0,
      sum(n) OVER (PARTITION BY model) AS nn, sum(p) OVER (PARTITION BY model) AS pp
      FROM ladder WINDOW w AS (PARTITION BY model ORDER BY score DESC))
    SELECT model, round(sum((fp - fp0) * (tp + tp0) / CAST(2 AS DOUBLE)) / (CAST(max(nn) AS DOUBLE) * max(pp)), 6) AS area
    FROM t GROUP BY model""",
)
def roc_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.trapezoid_area(long_scores(spark, sf_dir), "score", "click", ("model",)), "area")


@query(
    "roc_curve",
    f"""WITH {LONG_SCORES}, {LADDER}, a AS (SELECT * FROM ladder WHERE model = 'score_a')
    SELECT score AS threshold, round(fp / (SELECT CAST(sum(n) AS DOUBLE) FROM a), 6) AS fpr,
    round(tp / (SELECT CAST(sum(p) AS DOUBLE) FROM a), 6) AS tpr FROM a
    UNION ALL SELECT CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)""",
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_points(scored(spark, sf_dir), "score_a", "click"), "fpr", "tpr")


@query(
    "average_precision",
    f"""WITH {LONG_SCORES}, {LADDER}
    SELECT model, round(sum(p * tp / CAST(tp + fp AS DOUBLE)) / sum(p), 6) AS ap FROM ladder GROUP BY model""",
)
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(long_scores(spark, sf_dir), "score", "click", ("model",)), "ap")


@query(
    "precision_recall",
    f"""WITH {LONG_SCORES}, h AS (SELECT model, round_even(score, 0) = 1 AS hit, click = 1 AS y FROM long_scores),
    c AS (SELECT model, count(*) FILTER (WHERE hit AND y) AS tp, count(*) FILTER (WHERE hit AND NOT y) AS fp,
      count(*) FILTER (WHERE NOT hit AND y) AS fn, count(*) FILTER (WHERE hit = y) AS good, count(*) AS n FROM h GROUP BY model)
    SELECT model, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS "precision",
    round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
    round(good / CAST(n AS DOUBLE), 6) AS accuracy FROM c""",
)
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.threshold_metrics(long_scores(spark, sf_dir), "score", "click", ("model",))
    return rounded(report, "precision", "recall", "accuracy")


FOLD_AUC = f"""folds AS (SELECT CAST({hash32_sql("ID || '_fold2017'")} % 5 AS INT) AS fold, click, score_a AS score FROM scored),
steps AS (SELECT fold, score, sum(click) AS p, sum(1 - click) AS n FROM folds GROUP BY fold, score),
ladder AS (SELECT fold, p, n, sum(p) OVER (PARTITION BY fold ORDER BY score DESC) AS tp FROM steps),
aucs AS (SELECT fold, sum(n * (tp - p / CAST(2 AS DOUBLE))) / (CAST(sum(p) AS DOUBLE) * sum(n)) AS auc
  FROM ladder GROUP BY fold)"""


@query(
    "cv_summary",
    f"""WITH {SCORED}, {FOLD_AUC} SELECT CAST(count(*) AS BIGINT) AS folds, round(avg(auc), 6) AS mean_auc,
    round(stddev_pop(auc), 6) AS std_auc FROM aucs""",
)
def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = split.add_fold(scored(spark, sf_dir), 5)
    summary = metrics.fold_summary(metrics.roc_auc(folds, "score_a", "click", ("fold",)), "auc")
    return rounded(summary, "mean_auc", "std_auc")


@query(
    "run_metrics",
    f"""WITH {LONG_SCORES}, {LADDER}, m AS (SELECT model,
      sum(n * (tp - p / CAST(2 AS DOUBLE))) / (CAST(sum(p) AS DOUBLE) * sum(n)) AS auc,
      sum(p * tp / CAST(tp + fp AS DOUBLE)) / sum(p) AS ap FROM ladder GROUP BY model)
    SELECT model AS run, 'auc' AS metric, round(auc, 6) AS value, printf('%s-auc-%.4f', model, auc) AS output FROM m
    UNION ALL SELECT model, 'ap', round(ap, 6), printf('%s-ap-%.4f', model, ap) FROM m""",
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per run and the output name that carries them."""
    ladder = metrics.score_ladder(long_scores(spark, sf_dir), "score", "click", ("model",))
    p, n, tp, fp = (F.col(c) for c in ("p", "n", "tp", "fp"))
    both = ladder.groupBy("model").agg(
        (F.sum(n * (tp - p / 2.0)) / (F.sum("p").cast("double") * F.sum("n"))).alias("auc"),
        (F.sum(p * tp / (tp + fp)) / F.sum("p")).alias("ap"),
    )
    rows = both.unpivot(["model"], ["auc", "ap"], "metric", "value").withColumnRenamed("model", "run")
    named = rows.withColumn("output", F.format_string("%s-%s-%.4f", "run", "metric", "value"))
    return rounded(named, "value")


@query(
    "best_iteration",
    f"""WITH {LOGS} SELECT run, first(iter ORDER BY AUC DESC, iter) AS best_iter, max(AUC) AS "best_AUC"
    FROM logs GROUP BY run""",
)
def best_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.best_iteration(samples.metric_logs(spark, sf_dir))


@query(
    "early_stop",
    f"""WITH {LOGS}, b AS (SELECT run, iter, max(AUC) OVER (PARTITION BY run ORDER BY iter) AS best FROM logs),
    s AS (SELECT b.run, b.iter, min(l.iter) AS peak FROM b JOIN logs l ON b.run = l.run AND l.AUC = b.best GROUP BY b.run, b.iter),
    e AS (SELECT run, min(iter) FILTER (WHERE iter - peak >= 5) AS stop, max(iter) AS last FROM s GROUP BY run)
    SELECT e.run, COALESCE(stop, last) AS stop_iter, s.peak AS best_iter, CASE WHEN stop IS NULL THEN 0 ELSE 1 END AS stopped
    FROM e JOIN s ON e.run = s.run AND s.iter = COALESCE(stop, last)""",
)
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.early_stop(samples.metric_logs(spark, sf_dir), patience=5)


@query(
    "time_left",
    """WITH t AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS iter,
      CAST((epoch_us(max(ts)) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS BIGINT) AS elapsed_ms FROM events GROUP BY 1)
    SELECT iter, elapsed_ms, CAST(round(elapsed_ms * (31 - iter - 1) / CAST(iter + 1 AS DOUBLE)) AS BIGINT) AS remaining_ms FROM t""",
)
def time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.time_left(samples.time_log(spark, sf_dir), iterations=31)


@query(
    "metric_gap",
    f"""WITH {LOGS} SELECT a.iter, a.AUC AS learn, b.AUC AS test, round(a.AUC - b.AUC, 6) AS gap
    FROM logs a JOIN logs b ON a.iter = b.iter WHERE a.run = 'all' AND b.run = 'click'""",
)
def metric_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = samples.metric_logs(spark, sf_dir)
    return rounded(logs.metric_gap(log.where("run = 'all'"), log.where("run = 'click'")), "gap")


@query(
    "blend_predictions",
    f"WITH {SCORED} SELECT ID, round(0.2855 * score_a + 0.7145 * score_b, 6) AS click FROM scored WHERE split = 'test'",
)
def blend_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two prediction files are read back and blended by ID."""
    test = scored(spark, sf_dir).where("split = 'test'")
    paths = [
        writers.write_csv(writers.submission_frame(test, c), new_path(spark, c)) for c in ("score_a", "score_b")
    ]
    stacked, boosted = (readers.read_predictions(spark, p) for p in paths)
    mixed = ensemble.blend([(stacked, ensemble.STACK_WEIGHT), (boosted, ensemble.BOOST_WEIGHT)])
    return rounded(mixed, "click")


_SWEEP = [0.0, ensemble.ALT_STACK_WEIGHT, ensemble.STACK_WEIGHT, 0.5, 1.0]


@query(
    "blend_sweep",
    f"""WITH {SCORED}, w AS (SELECT unnest([{", ".join(map(str, _SWEEP))}]::DOUBLE[]) AS weight),
    b AS (SELECT weight, click, weight * score_a + (1 - weight) * score_b AS score FROM scored, w),
    steps AS (SELECT weight, score, sum(click) AS p, sum(1 - click) AS n FROM b GROUP BY weight, score),
    ladder AS (SELECT weight, p, n, sum(p) OVER (PARTITION BY weight ORDER BY score DESC) AS tp FROM steps),
    a AS (SELECT weight, round(sum(n * (tp - p / CAST(2 AS DOUBLE))) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS auc
      FROM ladder GROUP BY weight)
    SELECT weight, auc, CAST(rank() OVER (ORDER BY auc DESC) AS INT) AS "rank" FROM a""",
)
def blend_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of every blend weight; all weights share one aggregation."""
    mixed = ensemble.blend_sweep(scored(spark, sf_dir), "score_a", "score_b", _SWEEP, "click")
    aucs = rounded(metrics.roc_auc(mixed, "score", "click", ("weight",)), "auc")
    return ensemble.rank_sweep(aucs, "auc")


@query(
    "model_scores_long",
    f"""WITH {SCORED}, t AS (SELECT * FROM scored WHERE split = 'test')
    SELECT ID, 'stacked' AS model, score_a AS click FROM t UNION ALL SELECT ID, 'boosted', score_b FROM t
    UNION ALL SELECT ID, 'blend', round(0.2855 * score_a + 0.7145 * score_b, 6) FROM t""",
)
def model_scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and blend, written one folder per model and read back."""
    test = scored(spark, sf_dir).where("split = 'test'")
    mixed = F.round(ensemble.STACK_WEIGHT * F.col("score_a") + ensemble.BOOST_WEIGHT * F.col("score_b"), 6)
    names = {"stacked": "score_a", "boosted": "score_b", "blend": "mixed"}
    long = ensemble.model_scores_long(test.withColumn("mixed", mixed), names)
    path = writers.write_model_scores(long, new_path(spark, "models"))
    return spark.read.schema("ID string, click double, model string").csv(path, header=True).select("ID", "model", "click")
