"""Pair-count features: how often a pair of values occurs within its split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.operators.lookup import DEFAULT_LIMITS, JoinLimits, lookup_join, row_bytes, within_total
from clickloom.session import materialize

# The named count features and their key pairs.
PAIRS: dict[str, tuple[str, str]] = {
    "site_offer_count": ("siteid", "offerid"),
    "site_cat_count": ("siteid", "category"),
    "site_mcht_count": ("siteid", "merchant"),
    "site_ad_count": ("siteid", "ID"),
    "site_device_count": ("siteid", "devid"),
    "device_id_count": ("devid", "ID"),
    "device_offer_count": ("devid", "offerid"),
    "merchant_device_count": ("merchant", "devid"),
    "category_ad_count": ("category", "ID"),
    "browser_ad_count": ("browserid", "ID"),
    "country_ad_count": ("countrycode", "ID"),
    "country_offer_count": ("countrycode", "offerid"),
    "country_site_count": ("countrycode", "siteid"),
    "country_browser_count": ("countrycode", "browserid"),
    "device_browser_count": ("devid", "browserid"),
    "thour_id_count": ("thour", "ID"),
    "tweek_id_count": ("tweekday", "ID"),
    "tminute_id_count": ("tminute", "ID"),
    "category_id_count": ("category", "ID"),
}

_NAMES = list(PAIRS)
FEATURE_SETS: dict[int, list[str]] = {n: _NAMES[:n] for n in (3, 6, 15, 19)}


def pair_count(df: DataFrame, a: str, b: str, name: str, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """Rows per ``(a, b)`` within ``by``; pairs with a null are left out."""
    held = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return held.groupBy(*by, a, b).agg(F.count("*").alias(name))


def pair_tables(df: DataFrame, pairs: list[tuple[str, str]], by: tuple[str, ...] = ("split",)) -> DataFrame:
    """Counts of all pairs in one scan and one shuffle, with a ``pair`` number per row."""
    keys = list(dict.fromkeys(c for p in pairs for c in p))
    sets = [[F.col(c) for c in (*by, a, b)] for a, b in pairs]
    unused = [F.grouping(k).alias(f"_g_{k}") for k in keys]
    counted = df.groupingSets(sets, *by, *keys).agg(F.count("*").alias("n"), *unused)
    number = F.coalesce(
        *[
            F.when((F.col(f"_g_{a}") == 0) & (F.col(f"_g_{b}") == 0), F.lit(i))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return counted.select(number.alias("pair"), *by, *keys, "n")


def add_pair_counts(
    df: DataFrame,
    features: list[str],
    by: tuple[str, ...] = ("split",),
    row_key: str = "ID",
    null_keys: str = "drop",
    limits: JoinLimits = DEFAULT_LIMITS,
    unique_key: bool = False,
) -> DataFrame:
    """Add the named count features.

    ``null_keys="drop"`` leaves out rows with a null in any key used, as an inner join on
    the keys does; ``"keep"`` counts nulls as a value of their own.

    Pairs of ordinary columns are aggregated together and joined back. Pairs with the near-unique ``row_key`` have as
    many groups as rows; they share one shuffle on it, or none where ``unique_key`` declares that it has no repeats. The
    rows are derived once.
    """
    if null_keys not in ("drop", "keep"):
        raise ValueError(f"null_keys must be 'drop' or 'keep', not {null_keys!r}")
    wanted = {f: PAIRS[f] for f in features}
    columns = key_columns(features)
    pairs = list(dict.fromkeys(wanted.values()))
    with_row = [p for p in pairs if row_key in p]
    plain = [p for p in pairs if row_key not in p]
    if plain and with_row or len(plain) > 1:
        df = materialize(df, "counted")
    if with_row and not unique_key and _may_overload(df, row_key, limits):
        plain, with_row = pairs, []

    out = df
    if with_row and unique_key:
        # A pair with a null in it is counted as its own value, as below.
        out = out.select("*", *[F.lit(1).cast("bigint").alias(_column(p)) for p in with_row])
    elif with_row:
        out = _row_key_counts(df, with_row, by, row_key)
    # Counts are taken before rows go, so a pair still counts rows with nulls elsewhere.
    out = out.na.drop(subset=columns) if null_keys == "drop" else out
    if plain:
        out = _join_pair_tables(df, out, plain, by, null_keys == "keep", limits)
    return out.select(*df.columns, *[F.col(_column(p)).alias(f) for f, p in wanted.items()])


def key_columns(features: list[str]) -> list[str]:
    """Columns the named features are keyed on."""
    return list(dict.fromkeys(c for f in features for c in PAIRS[f]))


def _column(pair: tuple[str, str]) -> str:
    return f"_n_{pair[0]}_{pair[1]}"


def _may_overload(df: DataFrame, row_key: str, limits: JoinLimits) -> bool:
    """Whether a value of the row key could fill a task: a bin of a small hash histogram stands out.

    No value has more rows than its bin, so the keys themselves are not shuffled to find out.
    """
    bins = df.groupBy(F.pmod(F.xxhash64(row_key), F.lit(4096)).alias("b")).count()
    most, mean = bins.agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.avg("count"), F.lit(0.0))).first()
    return most > limits.hot_rows + 2 * mean


def _row_key_counts(df: DataFrame, pairs: list[tuple[str, str]], by: tuple[str, ...], row_key: str) -> DataFrame:
    """Counts per pair with the row key; every window reuses the one shuffle on it."""
    placed = df.repartition(*by, row_key)
    over = {p: Window.partitionBy(*by, row_key, *[c for c in p if c != row_key]) for p in pairs}
    return placed.select("*", *[F.count("*").over(w).alias(_column(p)) for p, w in over.items()])


def _join_pair_tables(
    df: DataFrame,
    out: DataFrame,
    pairs: list[tuple[str, str]],
    by: tuple[str, ...],
    null_safe: bool,
    limits: JoinLimits,
) -> DataFrame:
    tables = materialize(pair_tables(df, pairs, by), "pairs", ("pair",))
    sizes = {
        r["pair"]: r["b"]
        for r in tables.groupBy("pair").agg(F.sum(row_bytes(tables)).alias("b")).collect()
    }
    sizes = within_total(sizes, limits)
    for i, (a, b) in enumerate(pairs):
        one = tables.where(F.col("pair") == i)
        if not null_safe:
            one = one.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        one = one.select(*by, a, b, F.col("n").alias(_column((a, b))))
        out = lookup_join(
            out, one, [*by, a, b], "inner", null_safe, _column((a, b)), limits, sizes.get(i, 0)
        )
    return out
