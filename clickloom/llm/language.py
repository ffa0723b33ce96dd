"""Languages of each text as a mixture, inferred by expectation-maximisation.

A text is seen as three-byte grams: ASCII letters in lower case, all other ASCII as blanks, blanks merged. Each language
is a distribution over gram bins, counted over all labelled texts. For a text, expectation-maximisation finds the
proportions under which its grams are most likely. The language set is chosen by penalised likelihood: languages are
added in the order of their proportions while each adds more than its penalty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm import arrow

BINS = 1 << 16
UNKNOWN = "und"
SMOOTHING = 0.5
ITERATIONS = 12
# Grams overlap, so three of them count as one observation.
OVERLAP = 3.0
# Penalty of a further language, in halves of the logarithm of the observations.
PENALTY = 4.0

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


@dataclass
class Model:
    """Sorted languages and the log-probability of each gram bin (bins x languages)."""

    langs: list[str]
    logp: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram bin and text number of every gram; a gram has no two blanks side by side and stays in its text."""
    c = _CLASS[data]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    blank = c == 32
    keep = np.ones(len(c), bool)
    if len(c):
        keep[1:] = ~(blank[1:] & blank[:-1] & (text[1:] == text[:-1]))
    c, text = c[keep].astype(np.uint32), text[keep]
    if len(c) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    gram = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    gram = (gram * np.uint32(2654435761)) >> np.uint32(16)
    same = text[:-2] == text[2:]
    return gram[same], text[:-2][same]


def held_out(id_col: str = "doc_id", folds: int = 3) -> Column:
    """True for the rows kept for evaluation; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 1, F.lit(False))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Gram counts of every labelled text, summed per language.

    The driver gets at most BINS counts per language. Rows without text or language teach nothing; repeated rows count
    each time; an empty table gives a model without languages.
    """
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for step in arrow.steps(batches, "text"):
            lang = step.column(0).dictionary_encode()
            names, code = lang.dictionary.to_pylist(), np.asarray(lang.indices)
            gram, text = grams(*arrow.raw(step.column(1)))
            per = np.bincount(code[text] * BINS + gram, minlength=len(names) * BINS).reshape(-1, BINS)
            for name, n in zip(names, per):
                total[name] = total[name] + n if name in total else n
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bin", "n"])

    counts = rows.dropna().mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    name, at, n = (table.column(c).to_numpy() for c in ("lang", "bin", "n"))
    langs = sorted(set(name.tolist()))
    p = np.full((BINS, len(langs)), SMOOTHING)
    np.add.at(p, (at, np.searchsorted(np.array(langs, object), name)), n) if len(langs) else None
    return Model(langs, np.log(p / p.sum(axis=0)).astype(np.float32))


def _em(p: np.ndarray, n: np.ndarray, start: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text over its allowed languages.

    p: gram probabilities (rows sorted by text); n: gram counts; start: first row of each text; size: its rows.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(n, start)[:, None]
    for _ in range(ITERATIONS):
        r = p * np.repeat(share, size, axis=0)
        r *= (n / r.sum(axis=1))[:, None]
        share = np.add.reduceat(r, start, axis=0) / total
    mix = (p * np.repeat(share, size, axis=0)).sum(axis=1)
    return share, np.add.reduceat(n * np.log(mix), start)


def infer(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages, zero outside the chosen set) and mean log-likelihood of a gram."""
    k = len(model.langs)
    shares, fit_ = np.zeros((len(column), k)), np.full(len(column), np.nan)
    gram, text = grams(*arrow.raw(column))
    if not len(gram) or not k:
        return shares, fit_
    key = text.astype(np.uint64) << np.uint64(16) | gram
    key = np.sort(key.astype(np.uint32) if len(column) <= BINS else key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(first, len(key))).astype(np.float32)
    key = key[first].astype(np.int64)
    text, gram = key >> 16, key & (BINS - 1)
    start = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.append(start, len(text)))
    who = text[start]
    logp = model.logp[gram]
    # Only ratios between languages matter for proportions: scale each gram by its likeliest language.
    top = logp.max(axis=1)
    p = np.exp(logp - top[:, None])
    base = np.add.reduceat(n * top, start)
    total = np.add.reduceat(n, start)
    whole, _ = _em(p, n, start, size, np.ones((len(who), k), np.float32))
    rank = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1, kind="stable")
    # One language alone is the likeliest of all; larger sets follow the proportions.
    single = np.add.reduceat(n[:, None] * np.log(np.maximum(p, 1e-30)), start, axis=0)
    best = np.zeros((len(who), k), np.float32)
    best[np.arange(len(who)), single.argmax(axis=1)] = 1
    value = single.max(axis=1) / OVERLAP
    likely = single.max(axis=1)
    cost = PENALTY * 0.5 * np.log(np.maximum(total / OVERLAP, 2))
    on = np.arange(len(who))
    for many in range(2, k + 1):
        rows = np.repeat(np.isin(np.arange(len(who)), on), size)
        share, log = _em(p[rows], n[rows], np.cumsum(size[on]) - size[on], size[on], (rank[on] < many).astype(np.float32))
        score = log / OVERLAP - cost[on] * (many - 1)
        better = score > value[on]
        won = on[better]
        best[won], value[won], likely[won] = share[better], score[better], log[better]
        on = won
        if not len(on):
            break
    shares[who], fit_[who] = best, (likely + base) / total
    return shares, fit_


def _unused(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it; Spark's names do not tell cases apart."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``score`` (share of that language), ``shares`` (language to share) and ``fit``.

    Columns of these names are replaced, all others stay in place. A null text, one without a letter, and every text under a
    model without languages get ``und``, score 0, no shares. A tie goes to the first language in code point order. ``fit``
    is the mean log-likelihood of a gram, null where there is none. Texts of any length are read whole, one step of
    bounded size at a time; repeated rows are judged alike.
    """
    session = docs.sparkSession
    names = ["lang_pred", "score", "shares", "fit"]
    docs = docs.drop(*names)
    shared = session.sparkContext.broadcast(model)
    # The letter test follows Unicode, which the JVM's patterns know.
    lettered = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    kinds = (T.StringType(), T.DoubleType(), T.MapType(T.StringType(), T.DoubleType()), T.DoubleType())
    out_type = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in zip(names, kinds))])
    flag = _unused("__lettered", docs.columns)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for step in arrow.steps(batches, text_col):
            ok = np.asarray(arrow.column(step, flag)) & bool(m.langs)
            shares, fit_ = infer(arrow.column(step, text_col), m)
            if m.langs:
                # A lettered text too short for a gram has no evidence: the first language, without any share.
                pred = [m.langs[j] if o else UNKNOWN for j, o in zip(shares.argmax(axis=1).tolist(), ok.tolist())]
                score = np.where(ok, np.minimum(shares.max(axis=1), 1.0), 0.0)
            else:
                pred, score = [UNKNOWN] * step.num_rows, np.zeros(step.num_rows)
            mixed = [[(m.langs[j], float(row[j])) for j in np.flatnonzero(row > 0)] if o else [] for row, o in zip(shares, ok.tolist())]
            kept = [arrow.column(step, f.name) for f in out_type.fields[: -len(names)]]
            new = [
                pa.array(pred, pa.string()),
                pa.array(score),
                pa.array(mixed, pa.map_(pa.string(), pa.float64())),
                pa.array(fit_, mask=np.isnan(fit_)),
            ]
            yield pa.RecordBatch.from_arrays([*kept, *new], [f.name for f in out_type.fields])

    return docs.withColumn(flag, lettered).mapInArrow(predict, out_type)


def keep(docs: DataFrame, model: Model, share: float, text_col: str = "text") -> DataFrame:
    """The rows of which some language holds at least ``share``, all columns as they are.

    Null texts, texts without a letter, mixtures without such a language and, under a model without languages, all go; a
    share of 0 keeps every text that ``identify`` gives a language. Repeated rows are judged alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flag = _unused("__lettered", docs.columns)
    lettered = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in arrow.steps(batches, text_col):
            shares, _ = infer(arrow.column(step, text_col), shared.value)
            best = shares.max(axis=1) if shared.value.langs else np.full(step.num_rows, -1.0)
            yield step.filter(pa.array(np.asarray(arrow.column(step, flag)) & (best >= share))).select(names)

    return docs.withColumn(flag, lettered).mapInArrow(run, docs.schema)
