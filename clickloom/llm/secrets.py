"""Secrets in texts: fixed patterns, and random strings told from identifiers by two character Markov models.

Everything runs as DataFrame functions. A span is a struct of start, rank of its kind, end (code points, end exclusive) and
kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.shapes import bound, running

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
# A run that is too short fails as a whole, and so does every later start inside it: the least length can be in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

# Strings that the models judge: runs of these characters, with a letter and a digit among them.
SHORTEST = 20
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}" % SHORTEST
# Log-likelihood ratio from which a string counts as random.
THRESHOLD = 10.0
# Bounds of the labelled samples: documents that give ordinary words (expected number), and random strings.
SAMPLE_DOCS = 2000
SAMPLE_RANDOM = 6000
# Printable ASCII.
SYMBOLS = 96


def _spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Leftmost matches that do not overlap, as spans; ``keep`` tests the text of a group.

    The lengths of the matches and of the pieces between them, summed up, are the positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(hits, lambda m: F.char_length(m).cast("long"))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p).cast("long"))
    steps = F.zip_with(sizes, F.slice(pieces, F.lit(1), F.size(sizes)), lambda m, p: m + p)
    found = F.zip_with(
        running(steps), sizes,
        lambda end, size: F.struct((end - size).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")),
    )
    if keep is not None:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        pairs = F.zip_with(found, values, lambda s, v: F.struct(s.alias("s"), v.alias("v")))
        found = F.transform(F.filter(pairs, lambda p: keep(p["v"])), lambda p: p["s"])
    return F.when(text.rlike(pattern), found).otherwise(F.expr(EMPTY))


EMPTY = "CAST(array() AS array<struct<start:bigint,rank:int,end:bigint,kind:string>>)"


def _pairs(token: Column) -> Column:
    """Numbers of all neighbouring character pairs of a string of printable ASCII."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - 32)
    return bound(
        codes,
        lambda x: F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(2), F.size(x)), lambda a, b: a * SYMBOLS + b),
    )


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(string, random) for the models: words of a bounded sample of documents, and random strings of three alphabets.

    Words are taken from about SAMPLE_DOCS documents, those whose hash of id and text is least, fixed patterns removed.
    """
    share = SAMPLE_DOCS / max(docs.count(), 1)
    place = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col)), 11) / F.lit(2.0**53)
    sample = docs.where(F.col(text_col).isNotNull() & (place < share)).select(F.col(text_col).alias("text"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = sample.select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_=-]{5,}"), F.lit(0))).alias("string"))
    seed = docs.sparkSession.range(SAMPLE_RANDOM).select(F.sha2(F.col("id").cast("string"), 256).alias("x"), "id")
    packed = F.base64(F.unhex(F.concat("x", F.md5("x"))))
    by_kind = F.when(F.col("id") % 3 == 0, F.col("x")).when(F.col("id") % 3 == 1, packed).otherwise(F.upper(F.regexp_replace(packed, "[+/=]", "")))
    return words.withColumn("random", F.lit(False)).unionByName(seed.select(by_kind.alias("string"), F.lit(True).alias("random")))


def fit(sample: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character pair (first * SYMBOLS + second), random against ordinary.

    Both models are first-order Markov chains with one added count. Null strings and characters outside printable ASCII
    teach nothing; without samples of a label its chain is uniform.
    """
    pairs = sample.dropna().select("random", F.explode(_pairs(F.regexp_replace("string", r"[^\x20-\x7E]", ""))).alias("pair"))
    count = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    logp: dict[bool, list[float]] = {}
    for label in (False, True):
        table = [count.get((label, p), 0) + 1 for p in range(SYMBOLS * SYMBOLS)]
        rows = [sum(table[i * SYMBOLS : (i + 1) * SYMBOLS]) for i in range(SYMBOLS)]
        logp[label] = [math.log(table[a * SYMBOLS + b] / rows[a]) for a, b in product(range(SYMBOLS), repeat=2)]
    return [round(r - o, 3) for r, o in zip(logp[True], logp[False])]


def ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of a string, random against ordinary."""
    return F.aggregate(_pairs(token), F.lit(0.0), lambda total, p: total + F.element_at(table, p + 1))


def spans(text: str | Column, model: list[float]) -> Column:
    """All spans of a text by start, then kind (assign, access, hex, random).

    Null is the empty text; empty texts have no spans; a text may have any length and any number of spans. A random string
    is added only where it touches no span of a pattern.
    """
    text = F.col(text) if isinstance(text, str) else text
    text = F.coalesce(text.cast("string"), F.lit(""))
    # One literal for the optimiser, not thousands of them.
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    base = F.concat(
        _spans(text, ASSIGN, "assign", lambda v: F.char_length(v) >= 6, 2), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")
    )

    def judged(v: Column) -> Column:
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (ratio(v, table) >= THRESHOLD)

    def joined(x: Column) -> Column:
        free = F.filter(x["more"], lambda m: ~F.exists(x["base"], lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
        return F.array_sort(F.concat(x["base"], free))

    return bound(F.struct(base.alias("base"), _spans(text, RUN, "random", judged).alias("more")), joined)


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``spans`` of every row. Repeated rows are scanned each; other columns are ignored."""
    return docs.select(F.col(id_col), spans(text_col, model).alias("spans"))


def clean(docs: DataFrame, model: list[float], text_col: str = "text") -> DataFrame:
    """The rows without any span, all columns as they are; null and empty texts stay."""
    return docs.where(F.size(spans(text_col, model)) == 0)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256 and spans (text) of a ``scan``."""

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scanned.select(
        F.col(id_col), *map(number, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
