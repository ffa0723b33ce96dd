"""Queries over sources, sinks, profiles and preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import scalar as fn
from clickloom.operators import logs, metrics, prep, profile
from clickloom.operators.lookup import lookup_join
from clickloom.plans.registry import IMP, LOGS, PREP, SCORED, SPARSE, hash32_sql, query, rounded
from clickloom.session import materialize, new_path
from clickloom.sources import readers, samples, writers

SCALED_A = 0.98
P_SQL = "(0.01 + CAST(0.98 AS DOUBLE) * score_a)"


def _csv_impressions(spark: SparkSession, sf_dir: str) -> str:
    return writers.write_csv(samples.impressions(spark, sf_dir), new_path(spark, "impressions"))


@query("scan_impressions", f"WITH {IMP} SELECT * FROM imp")
def scan_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_impressions(spark, _csv_impressions(spark, sf_dir))


@query(
    "scan_strings",
    f"""WITH {IMP} SELECT ID, COALESCE(CAST(siteid AS VARCHAR), '') AS siteid, CAST(offerid AS VARCHAR) AS offerid,
    COALESCE(browserid, '') AS browserid, CAST(click AS VARCHAR) AS click FROM imp""",
)
def scan_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_strings(spark, _csv_impressions(spark, sf_dir))
    return rows.select("ID", "siteid", "offerid", "browserid", "click")


@query(
    "scan_sparse_text",
    f"WITH {SPARSE} SELECT CAST(y AS DOUBLE) AS y, idx, round(value, 6) AS value FROM sparse",
)
def scan_sparse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "sparse")
    writers.sparse_lines(samples.sparse_rows(spark, sf_dir)).write.text(path)
    rows = readers.read_sparse_text(spark, path)
    long = rows.select("y", F.explode("features").alias("f")).select("y", "f.idx", "f.value")
    return rounded(long, "value")


@query(
    "scan_numeric",
    """SELECT CAST(d.doc_id AS DOUBLE) AS doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars,
    CAST(l.toxic AS DOUBLE) AS toxic, CAST(l.quality AS DOUBLE) AS target
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def scan_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = samples.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = samples.table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id")
    names = ["doc_id", "n_chars", "toxic", "class"]
    doubles = joined.withColumnRenamed("quality", "class").select(*[F.col(c).cast("double") for c in names])
    path = writers.write_csv(doubles, new_path(spark, "numeric"), sep=";")
    rows = readers.read_numeric(spark, path, names, sep=";")
    return rows.select("*", F.col("class").alias("target")).drop("class")


@query(
    "metric_log_profile",
    f"""WITH {LOGS} SELECT CAST(count(*) AS BIGINT) AS n, min(AUC) AS low, max(AUC) AS high,
    round(avg(AUC), 6) AS mean, max(iter) AS last_iter FROM logs WHERE run = 'all'""",
)
def metric_log_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = samples.metric_logs(spark, sf_dir).where("run = 'all'").select("iter", "AUC")
    path = writers.write_csv(logs, new_path(spark, "log"), sep="\t")
    log = readers.read_metric_log(spark, path)
    report = log.agg(
        F.count("*").alias("n"),
        F.min("AUC").alias("low"),
        F.max("AUC").alias("high"),
        F.avg("AUC").alias("mean"),
        F.max("iter").alias("last_iter"),
    )
    return rounded(report, "mean")


@query(
    "run_meta",
    f"""WITH {LOGS} SELECT run AS "key", CAST(count(*) AS VARCHAR) AS "value" FROM logs GROUP BY run""",
)
def run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = samples.metric_logs(spark, sf_dir).groupBy("run").agg(F.count("*").cast("string").alias("value"))
    path = writers.write_csv(counts.select("run", "value"), new_path(spark, "meta"), header=False, sep="\t")
    return readers.read_run_meta(spark, path)


@query("submission_frame", f"WITH {SCORED} SELECT ID, score_a AS click FROM scored WHERE split = 'test'")
def submission_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = samples.with_scores(samples.impressions(spark, sf_dir)).where("split = 'test'")
    path = writers.write_csv(writers.submission_frame(test, "score_a"), new_path(spark, "submission"))
    return readers.read_predictions(spark, path)


@query(
    "row_id_sink",
    f"""WITH {SCORED} SELECT CAST(row_number() OVER (ORDER BY datetime, ID) - 1 AS BIGINT) AS ID,
    score_a AS target FROM scored WHERE split = 'test'""",
)
def row_id_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = samples.with_scores(samples.impressions(spark, sf_dir)).where("split = 'test'")
    keyed = test.select(F.col("ID").alias("row_key"), "datetime", F.col("score_a").alias("score"))
    return writers.row_id_frame(keyed, "score", ["datetime", "row_key"])


_FEATURES = [
    "browserid", "category", "countrycode", "devid", "merchant", "offerid", "siteid", "thour", "tminute", "tweekday",
]


@query(
    "feature_map",
    f"""WITH {PREP}, held AS (UNPIVOT (SELECT {", ".join(f"count({c}) AS {c}" for c in _FEATURES)} FROM prep)
    ON {", ".join(_FEATURES)} INTO NAME name VALUE n)
    SELECT CAST(list_position([{", ".join(f"'{c}'" for c in _FEATURES)}], name) - 1 AS INT) AS idx,
    name, 'q' AS type FROM held WHERE n > 0""",
)
def feature_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prep.prepare(samples.impressions(spark, sf_dir))
    return writers.feature_map(df, prep.feature_columns(df))


@query(
    "profile_shape",
    f"WITH {IMP} SELECT split, CAST(count(*) AS BIGINT) AS n_rows, 10 AS n_cols FROM imp GROUP BY split",
)
def profile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.shape(samples.impressions(spark, sf_dir), "split")


_COLUMNS = [
    "ID", "datetime", "siteid", "offerid", "category", "merchant", "countrycode", "browserid", "devid", "click",
]


@query(
    "null_fraction",
    f"WITH {IMP} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_fraction
        FROM imp WHERE split = 'train'"""
        for c in _COLUMNS
    ),
)
def null_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = samples.impressions(spark, sf_dir).where("split = 'train'").drop("split")
    return rounded(profile.null_fraction(train), "null_fraction")


@query("preview", f"WITH {IMP} SELECT * FROM imp ORDER BY datetime, ID LIMIT 5")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.preview(samples.impressions(spark, sf_dir), ["datetime", "ID"], 5)


@query(
    "running_loss",
    f"""WITH {SCORED}, l AS (SELECT datetime, ID,
      CASE WHEN click = 1 THEN -ln({P_SQL}) ELSE -ln(1 - {P_SQL}) END AS loss FROM scored),
    r AS (SELECT row_number() OVER w - 1 AS t, loss, sum(loss) OVER w AS s FROM l WINDOW w AS (ORDER BY datetime, ID))
    SELECT CAST(t AS BIGINT) AS t, CASE WHEN t = 0 THEN 0.0 ELSE round((s - loss) / t, 6) END AS mean_loss
    FROM r WHERE t % 100 = 0""",
)
def running_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples.with_scores(samples.impressions(spark, sf_dir))
    loss = fn.log_loss(0.01 + SCALED_A * F.col("score_a"), F.col("click"))
    return rounded(profile.running_mean_loss(df, loss, ["datetime", "ID"], 100), "mean_loss")


@query("project_features", f"WITH {PREP} SELECT {', '.join(_FEATURES)} FROM prep")
def project_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.project_features(prep.prepare(samples.impressions(spark, sf_dir)))


@query(
    "cast_categorical",
    f"""WITH {IMP} SELECT ID, CAST(CAST(siteid AS BIGINT) AS VARCHAR) AS siteid, CAST(offerid AS VARCHAR) AS offerid,
    CAST(category AS VARCHAR) AS category, CAST(merchant AS VARCHAR) AS merchant FROM imp""",
)
def cast_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = ["siteid", "offerid", "category", "merchant"]
    return prep.cast_categorical(samples.impressions(spark, sf_dir).select("ID", *codes), codes)


@query(
    "impute_constants",
    f"""WITH {IMP} SELECT ID, COALESCE(siteid, -999.0) AS siteid, COALESCE(browserid, 'None') AS browserid,
    COALESCE(devid, 'None') AS devid, COALESCE(browserid, 'Desktop') AS browser_alt,
    COALESCE(devid, 'Mozilla Firefox') AS device_alt FROM imp""",
)
def impute_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    imps = samples.impressions(spark, sf_dir)
    both = imps.withColumns({"browser_alt": F.col("browserid"), "device_alt": F.col("devid")})
    alternative = {"browser_alt": prep.FILL_DESKTOP["browserid"], "device_alt": prep.FILL_DESKTOP["devid"]}
    filled = prep.impute(prep.impute(both), alternative)
    return filled.select("ID", "siteid", "browserid", "devid", "browser_alt", "device_alt")


@query(
    "label_from_text",
    f"""WITH {IMP} SELECT ID, split, CASE WHEN split = 'train' AND click = 1 THEN CAST(1 AS DOUBLE)
    ELSE CAST(0 AS DOUBLE) END AS y FROM imp""",
)
def label_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_strings(spark, _csv_impressions(spark, sf_dir))
    train = prep.label_from_text(rows.where("split = 'train'"))
    test = prep.label_from_text(rows.where("split = 'test'").drop("click"))
    return train.select("ID", "split", "y").unionByName(test.select("ID", "split", "y"))


@query(
    "label_pm1",
    f"WITH {IMP} SELECT ID, CASE WHEN click = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(click AS DOUBLE) END AS y FROM imp",
)
def label_pm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.impressions(spark, sf_dir).select("ID", prep.label_pm1(F.col("click")).alias("y"))


@query(
    "holdout_filter",
    f"""WITH {IMP}, o AS (SELECT ID, datetime, row_number() OVER (ORDER BY datetime, ID) - 1 AS t
      FROM imp WHERE split = 'train')
    SELECT ID, CASE WHEN CAST(datetime AS DATE) > DATE '2024-01-25' OR t % 7 = 0 THEN 1 ELSE 0 END AS holdout FROM o""",
)
def holdout_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = samples.impressions(spark, sf_dir).where("split = 'train'").select("ID", "datetime")
    return prep.mark_holdout(train, ["datetime", "ID"], every=7, after="2024-01-25").select("ID", "holdout")


@query(
    "missing_indicator",
    f"""WITH {IMP} SELECT ID, COALESCE(siteid, -999.0) AS siteid, CASE WHEN siteid IS NULL THEN 1 ELSE 0 END AS siteid_missing,
    COALESCE(devid, 'None') AS devid, CASE WHEN devid IS NULL THEN 1 ELSE 0 END AS devid_missing FROM imp""",
)
def missing_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    imps = samples.impressions(spark, sf_dir).select("ID", "siteid", "devid")
    return prep.missing_indicators(imps, ["siteid", "devid"], prep.FILL_NONE)


@query("time_parts", f"WITH {PREP} SELECT ID, tweekday, thour, tminute FROM prep")
def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_strings(spark, _csv_impressions(spark, sf_dir)).select("ID", "datetime")
    return prep.add_time_parts(prep.parse_datetime(rows)).drop("datetime")


@query(
    "scalar_suite",
    f"""WITH {SCORED} SELECT ID, round(1 / (1 + exp(-(score_a - score_b))), 6) AS sigmoid,
    round(1 / (1 + exp(-greatest(least(100 * (score_a - score_b), 35.0), -35.0))), 6) AS bounded,
    greatest(least(score_a, 0.8), 0.2) AS clipped,
    CASE WHEN score_a - score_b < 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sign,
    CAST(round_even(score_a * 5, 0) AS DOUBLE) AS half_even,
    round(sqrt(score_a), 6) AS root, round(pow(score_b, 3), 6) AS cubed, abs(score_a - 0.5) AS distance,
    round(score_a * score_b + score_b * score_a, 6) AS dot,
    'offer_' || offerid AS token, {hash32_sql("'offer_' || offerid")} % 1048576 AS slot,
    round(ln(1 + score_a), 6) AS log1p, round(0.2855 * score_a + 0.7145 * score_b, 6) AS blend FROM scored""",
)
def scalar_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples.with_scores(samples.impressions(spark, sf_dir))
    a, b = F.col("score_a"), F.col("score_b")
    suite = df.select(
        "ID",
        fn.sigmoid(a - b).alias("sigmoid"),
        fn.bounded_sigmoid(100 * (a - b)).alias("bounded"),
        fn.clip(a, 0.2, 0.8).alias("clipped"),
        fn.sign_or_one(a - b).alias("sign"),
        F.rint(a * 5).alias("half_even"),
        F.sqrt(a).alias("root"),
        F.pow(b, F.lit(3)).alias("cubed"),
        F.abs(a - 0.5).alias("distance"),
        fn.dot(F.array(a, b), F.array(b, a)).alias("dot"),
        F.concat_ws("_", F.lit("offer"), F.col("offerid").cast("string")).alias("token"),
        fn.token_index("offer", F.col("offerid"), 1 << 20).alias("slot"),
        F.log1p(a).alias("log1p"),
        (0.2855 * a + 0.7145 * b).alias("blend"),
    )
    return rounded(suite, "sigmoid", "bounded", "root", "cubed", "dot", "log1p", "blend")


@query(
    "lookup_enrich",
    """SELECT e.event_id, COALESCE(c.c_mktsegment, '') AS segment, COALESCE(CAST(c.c_nationkey AS VARCHAR), '') AS nation
    FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
)
def lookup_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the event's customer; events of unknown users keep empty ones."""
    e = samples.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("c_custkey"))
    c = samples.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    joined = lookup_join(e, c, ["c_custkey"], "left")
    return joined.select(
        "event_id",
        F.coalesce("c_mktsegment", F.lit("")).alias("segment"),
        F.coalesce(F.col("c_nationkey").cast("string"), F.lit("")).alias("nation"),
    )


@query(
    "split_hierarchy",
    """SELECT p_partkey, split_part(p_name, ' ', 1) AS level1, split_part(p_name, ' ', 2) AS level2,
    split_part(p_name, ' ', 3) AS level3 FROM part""",
)
def split_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = prep.split_hierarchy(samples.table(spark, sf_dir, "part"), "p_name", " ")
    return levels.select("p_partkey", "level1", "level2", "level3")


@query(
    "leakage_flag",
    """WITH seen AS (SELECT user_id, event_type FROM events GROUP BY user_id, event_type HAVING count(*) > 1)
    SELECT e.event_id, CASE WHEN s.user_id IS NULL THEN 0 ELSE 1 END AS leaked
    FROM events e LEFT JOIN seen s ON e.user_id = s.user_id AND e.event_type = s.event_type""",
)
def leakage_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the event's user has another event of its type, so that one tells about the other."""
    e = samples.table(spark, sf_dir, "events")
    known = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    known = materialize(known.withColumn("leaked", F.lit(1)), "known")
    flagged = lookup_join(e.select("event_id", "user_id", "event_type"), known, ["user_id", "event_type"], "left")
    return flagged.select("event_id", F.coalesce("leaked", F.lit(0)).alias("leaked"))


@query(
    "loss_metrics",
    f"""WITH {SCORED}, p AS (SELECT {P_SQL} AS p, CAST(click AS DOUBLE) AS y FROM scored)
    SELECT round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 6) AS logloss,
    round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS cross_entropy,
    round(avg(ln(1 + exp(-(CASE WHEN y = 0 THEN -1 ELSE y END) * p))), 6) AS margin_loss,
    round(avg((y - p) * (y - p)), 6) AS mse, round(avg(abs(exp(y) - exp(p))), 6) AS exp_mae,
    round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2 FROM p""",
)
def loss_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = samples.with_scores(samples.impressions(spark, sf_dir))
    report = metrics.loss_metrics(df.withColumn("p", 0.01 + SCALED_A * F.col("score_a")), "p", "click")
    return rounded(report, *report.columns)


@query(
    "scan_time_log",
    """WITH t AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS iter,
      CAST((epoch_us(max(ts)) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS BIGINT) AS elapsed_ms FROM events GROUP BY 1)
    SELECT iter, CAST(round(elapsed_ms * (31 - iter - 1) / CAST(iter + 1 AS DOUBLE)) AS BIGINT) AS remaining_ms, elapsed_ms
    FROM t""",
)
def scan_time_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = logs.time_left(samples.time_log(spark, sf_dir), iterations=31)
    lines = log.select("iter", "remaining_ms", "elapsed_ms")
    return readers.read_time_log(spark, writers.write_csv(lines, new_path(spark, "time"), header=False, sep="\t"))


@query("column_difference", f"WITH {IMP} SELECT ID, datetime, siteid, offerid, category, merchant, countrycode, browserid, devid FROM imp")
def column_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the train rows that the test rows have, too."""
    imps = samples.impressions(spark, sf_dir)
    return imps.select(*prep.columns_except(imps, ["click", "split"]))
