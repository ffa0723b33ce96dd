"""Queries over pair counts, encodings, hashing, samples and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import counts, encode, metrics, prep, sparse, split
from clickloom.operators.lookup import natural_join
from clickloom.operators.ordinal import global_ordinal
from clickloom.plans.registry import IMP, PREP, SPARSE, hash32_sql, query, rounded
from clickloom.session import materialize
from clickloom.sources import samples

HASHED = ["siteid", "offerid", "category", "merchant", "countrycode", "devid"]
SIZE = encode.HASH_SIZE


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.prepare(samples.impressions(spark, sf_dir))


def count_features_sql(n: int) -> str:
    cols = ", ".join(
        f"CAST(count(*) OVER (PARTITION BY split, {a}, {b}) AS BIGINT) AS {f}"
        for f, (a, b) in ((f, counts.PAIRS[f]) for f in counts.FEATURE_SETS[n])
    )
    return f"WITH {PREP} SELECT ID, split, {cols} FROM prep"


@query(
    "pair_count",
    f"""WITH {PREP} SELECT split, siteid, offerid, CAST(count(*) AS BIGINT) AS site_offer_count
    FROM prep GROUP BY split, siteid, offerid""",
)
def pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.pair_count(prepared(spark, sf_dir), "siteid", "offerid", "site_offer_count")


@query(
    "natural_join_counts",
    f"""WITH {IMP}, x AS (SELECT split, siteid, category, CAST(count(*) AS BIGINT) AS site_cat_count
      FROM imp WHERE siteid IS NOT NULL AND category IS NOT NULL GROUP BY split, siteid, category)
    SELECT imp.ID, x.site_cat_count FROM imp JOIN x
    ON imp.split = x.split AND imp.siteid = x.siteid AND imp.category = x.category""",
)
def natural_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not imputed first, so that impressions without a site drop out."""
    imps = samples.impressions(spark, sf_dir).select("ID", "split", "siteid", "category")
    x = materialize(counts.pair_count(imps, "siteid", "category", "site_cat_count"), "pairs")
    return natural_join(imps, x, weight="site_cat_count").select("ID", "site_cat_count")


def _count_features(n: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = counts.FEATURE_SETS[n]
        return counts.add_pair_counts(prepared(spark, sf_dir), names, unique_key=True).select("ID", "split", *names)

    return run


for _n in counts.FEATURE_SETS:
    query(f"count_features_{_n}", count_features_sql(_n))(_count_features(_n))


@query(
    "count_features_keep_nulls",
    f"""WITH {IMP} SELECT ID, split, CAST(count(*) OVER (PARTITION BY split, siteid, offerid) AS BIGINT) AS site_offer_count,
    CAST(count(*) OVER (PARTITION BY split, siteid, devid) AS BIGINT) AS site_device_count,
    CAST(count(*) OVER (PARTITION BY split, devid, browserid) AS BIGINT) AS device_browser_count FROM imp""",
)
def count_features_keep_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["site_offer_count", "site_device_count", "device_browser_count"]
    imps = samples.impressions(spark, sf_dir)
    return counts.add_pair_counts(imps, names, null_keys="keep", unique_key=True).select("ID", "split", *names)


@query(
    "label_encode",
    f"WITH {PREP} SELECT ID, "
    + ", ".join(
        f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS BIGINT) AS {c}"
        for c in ("countrycode", "browserid", "devid", "siteid", "offerid")
    )
    + " FROM prep",
)
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepared(spark, sf_dir)
    text = prep.columns_of_type(df, type(df.schema["ID"].dataType), exclude=("ID", "split"))
    return encode.label_encode(df.select("ID", *text, "siteid", "offerid"), [*text, "siteid", "offerid"])


_SCALED = ["siteid", "offerid", "category", "thour", "tminute"]


@query(
    "standardize",
    f"WITH {PREP} SELECT ID, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM prep WHERE split = 'train')) / "
        f"(SELECT stddev_pop({c}) FROM prep WHERE split = 'train'), 6) AS {c}"
        for c in _SCALED
    )
    + " FROM prep",
)
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = prepared(spark, sf_dir).select("ID", "split", *_SCALED)
    scaler = encode.fit_scaler(df.where("split = 'train'"), _SCALED)
    return rounded(encode.scale(df, scaler).select("ID", *_SCALED), *_SCALED)


@query(
    "one_hot",
    f"""WITH {IMP} SELECT ID, CASE WHEN click = 0 THEN 1 ELSE 0 END AS click_0,
    CASE WHEN click = 1 THEN 1 ELSE 0 END AS click_1 FROM imp""",
)
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.one_hot(samples.impressions(spark, sf_dir).select("ID", "click"), "click", [0, 1]).drop("click")


def slot_sql(column: str) -> str:
    text = f"CAST(CAST({column} AS BIGINT) AS VARCHAR)" if column == "siteid" else f"CAST({column} AS VARCHAR)"
    token = f"'{column}_' || {text}"
    return f"{hash32_sql(token)} % {SIZE}"


SLOTS = PREP + ", slots AS (SELECT ID, split, click, datetime, " + ", ".join(
    f"{slot_sql(c)} AS h{i}" for i, c in enumerate(HASHED)
) + " FROM prep)"
_N = len(HASHED)
SLOT_LIST = "[" + ", ".join(f"h{i}" for i in range(_N)) + "]"


def hashable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared impressions with whole-number site ids, as they would be spelt in a file."""
    return prep.cast_categorical(prepared(spark, sf_dir), ["siteid"])


@query(
    "hash_features",
    f"WITH {SLOTS} SELECT ID, unnest([CAST(0 AS BIGINT)] || {SLOT_LIST}) AS idx FROM slots",
)
def hash_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = encode.hash_features(hashable(spark, sf_dir), HASHED)
    return hashed.select("ID", F.explode_outer("x").alias("idx"))


_PAIRS_SQL = f"""pairs AS (
  SELECT ID, s[i.i] AS "left", s[j.j] AS "right"
  FROM (SELECT ID, list_sort({SLOT_LIST}) AS s FROM slots), range(1, {_N + 1}) i(i), range(1, {_N + 1}) j(j)
  WHERE i.i < j.j)"""


@query("pair_interactions", f"""WITH {SLOTS}, {_PAIRS_SQL} SELECT ID, "left", "right" FROM pairs""")
def pair_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.pair_interactions(hashable(spark, sf_dir), HASHED)


_CROSSED = hash32_sql("CAST(\"left\" AS VARCHAR) || '_' || CAST(\"right\" AS VARCHAR)")


@query(
    "hash_interactions",
    f"""WITH {SLOTS}, {_PAIRS_SQL}, x AS (
      SELECT ID, unnest([CAST(0 AS BIGINT)] || {SLOT_LIST}) AS idx FROM slots
      UNION ALL SELECT ID, {_CROSSED} % {SIZE} AS idx FROM pairs)
    SELECT ID, idx FROM x""",
)
def hash_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    crossed = encode.hash_interactions(hashable(spark, sf_dir), HASHED)
    return crossed.select("ID", F.explode_outer("x").alias("idx"))


@query(
    "row_normalize",
    f"""WITH {SPARSE}, n AS (SELECT vec_id, sum(value * value) AS s FROM sparse GROUP BY vec_id)
    SELECT vec_id, idx, round(value / s, 6) AS squared, round(value / sqrt(s), 6) AS l2
    FROM sparse JOIN n USING (vec_id)""",
)
def row_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples.sparse_rows(spark, sf_dir)
    both = encode.row_normalize(rows.withColumn("l2", F.col("features")), "features")
    both = encode.row_normalize(both, "l2", mode="l2")
    zipped = both.select("vec_id", F.explode_outer(F.arrays_zip("features", "l2")).alias("f"))
    long = zipped.select(
        "vec_id", "f.features.idx", F.col("f.features.value").alias("squared"), F.col("f.l2.value").alias("l2")
    )
    return rounded(long, "squared", "l2")


@query(
    "feature_dropout",
    f"""WITH {SPARSE} SELECT vec_id, idx FROM sparse
    WHERE {hash32_sql("vec_id || '_' || idx || '_1024'")} / CAST(4294967296 AS DOUBLE) >= 0.3""",
)
def feature_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = encode.feature_dropout(samples.sparse_rows(spark, sf_dir), 0.3, "vec_id")
    return sparse.to_long(kept, ["vec_id"]).select("vec_id", "idx")


@query(
    "sparse_dims",
    f"""WITH {SPARSE} SELECT CAST(count(DISTINCT vec_id) AS BIGINT) AS n_rows, max(idx) + 1 AS n_features FROM sparse""",
)
def sparse_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.sparse_dims(samples.sparse_rows(spark, sf_dir))


_CORRELATED = ["siteid", "offerid", "category", "merchant", "tweekday", "thour", "tminute", "click"]
_COUNTED = ["site_offer_count", "site_cat_count", "site_mcht_count", "site_device_count", "device_browser_count"]


def _corr_sql() -> str:
    cols = _CORRELATED + _COUNTED
    windows = ", ".join(
        f"CAST(count(*) OVER (PARTITION BY split, {a}, {b}) AS BIGINT) AS {f}"
        for f, (a, b) in ((f, counts.PAIRS[f]) for f in _COUNTED)
    )
    parts = [
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM w"
        for i, a in enumerate(cols)
        for b in cols[i + 1 :]
    ]
    return f"WITH {PREP}, w AS MATERIALIZED (SELECT *, {windows} FROM prep) " + " UNION ALL ".join(parts)


@query("corr_matrix", _corr_sql())
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = counts.add_pair_counts(prepared(spark, sf_dir), _COUNTED, unique_key=True)
    return rounded(metrics.correlation_pairs(df, _CORRELATED + _COUNTED), "corr")


def unit_sql(text: str) -> str:
    return f"{hash32_sql(text)} / CAST(4294967296 AS DOUBLE)"


@query(
    "sample_fraction",
    f"WITH {IMP} SELECT ID, click FROM imp WHERE split = 'train' AND {unit_sql("ID || '_2017'")} < 0.1",
)
def sample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = samples.impressions(spark, sf_dir).where("split = 'train'").select("ID", "click")
    return split.sample(train, 0.1)


@query(
    "sample_exact",
    f"""WITH {IMP}, o AS (SELECT ID, click, row_number() OVER (ORDER BY {unit_sql("ID || '_2017'")}, ID) - 1 AS pos,
      count(*) OVER () AS n FROM imp WHERE split = 'train')
    SELECT ID, click FROM o WHERE pos < round_even(n * CAST(0.6 AS DOUBLE), 0)""",
)
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = samples.impressions(spark, sf_dir).where("split = 'train'").select("ID", "click")
    return split.sample_exact(train, 0.6)


@query(
    "train_valid_split",
    f"""WITH {IMP}, o AS (SELECT ID, {unit_sql("ID || '_valid2017'")} AS place FROM imp WHERE split = 'train'),
    n AS (SELECT *, row_number() OVER (ORDER BY place, ID) - 1 AS pos, count(*) OVER () AS n FROM o)
    SELECT ID, CASE WHEN place < 0.1 THEN 1 ELSE 0 END AS valid_10, CASE WHEN place < 0.5 THEN 1 ELSE 0 END AS valid_50,
    CASE WHEN pos < ceil(n * CAST(0.2 AS DOUBLE)) THEN 1 ELSE 0 END AS valid_exact FROM n""",
)
def train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = samples.impressions(spark, sf_dir).where("split = 'train'").select("ID")
    tenth = split.mark_validation(train, 0.1).withColumnRenamed("is_valid", "valid_10")
    half = split.mark_validation(tenth, 0.5).withColumnRenamed("is_valid", "valid_50")
    exact = split.mark_validation_exact(half, 0.2).withColumnRenamed("is_valid", "valid_exact")
    return exact.select("ID", *[F.col(c).cast("int") for c in ("valid_10", "valid_50", "valid_exact")])


@query(
    "kfold_assign",
    f"WITH {IMP} SELECT ID, CAST({hash32_sql("ID || '_fold2017'")} % 5 AS INT) AS fold FROM imp WHERE split = 'train'",
)
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = samples.impressions(spark, sf_dir).where("split = 'train'").select("ID")
    return split.add_fold(train, 5)


@query(
    "global_ordinal",
    f"WITH {IMP} SELECT ID, CAST(row_number() OVER (ORDER BY datetime, ID) - 1 AS BIGINT) AS ordinal FROM imp",
)
def ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    imps = samples.impressions(spark, sf_dir).select("ID", "datetime")
    return global_ordinal(imps, ["datetime", "ID"]).drop("datetime")


@query(
    "base_rate",
    f"WITH {IMP} SELECT split, round(avg(click), 6) AS base_rate FROM imp GROUP BY split",
)
def base_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = samples.impressions(spark, sf_dir).groupBy("split").agg(F.avg("click").alias("base_rate"))
    return rounded(rates, "base_rate")
