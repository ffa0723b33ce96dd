"""Benchmark passages in documents, found by Wu-Manber search over words.

The letters of the search are words. For the test strings of one length m, a table gives for each block of two words how
far the search may jump: no test string can end before. At jump 0, the block is the end of some test strings; its bucket
lists them, the first words' hash drops most, and a comparison word by word, then byte by byte, confirms the rest.
All texts of a batch are searched in step: each lane of some hundred words jumps on its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import arrow
from clickloom.llm.words import Words, chain, words

WINDOW = 10
# Bytes of benchmark text that one broadcast holds; a larger benchmark is searched in several such blocks.
BLOCK_BYTES = 16 << 20
LANE = 256
SLOTS = 1 << 20


@dataclass
class Table:
    """Search tables of all test strings of ``length`` words."""

    length: int
    block: int
    shift: np.ndarray
    bucket: np.ndarray  # slots + 1 offsets into ``entry``
    entry: np.ndarray
    head: np.ndarray  # hash of the first block of each test string
    code: np.ndarray  # word hashes, one row for each test string
    text: list[bytes]
    items: list[list[str]]


def tables(items: Iterable[tuple[str | None, str]], window: int = WINDOW) -> list[Table]:
    """Tables of all windows of (id, text) items, by length. An item without id has windows but is not listed."""
    found: dict[int, dict[bytes, tuple[set[str], np.ndarray]]] = {}
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        w = words(data, np.array([0, len(data)]))
        m = min(window, len(w.start))
        for i in range(len(w.start) - m + 1 if m else 0):
            found.setdefault(m, {}).setdefault(w.text(i, m), (set(), w.code[i : i + m]))[0].update([] if item is None else [item])
    return [_table(m, found[m]) for m in sorted(found)]


def _table(m: int, found: dict[bytes, tuple[set[str], np.ndarray]]) -> Table:
    block = min(2, m)
    code = np.stack([c for _, c in found.values()])
    shift = np.full(SLOTS, m - block + 1, np.uint8 if m < 256 else np.int64)
    rows = np.arange(len(code))
    for k in range(m - block + 1):
        np.minimum.at(shift, _slot(chain(code.T, np.int64(k), block)), m - block - k)
    slot = _slot(chain(code.T, np.int64(m - block), block))
    order = np.argsort(slot, kind="stable")
    bucket = np.searchsorted(slot[order], np.arange(SLOTS + 1))
    head = chain(code.T, np.int64(0), block)
    return Table(m, block, shift, bucket, rows[order], head, code, list(found), [sorted(s) for s, _ in found.values()])


def _slot(code: np.ndarray) -> np.ndarray:
    return (code & np.uint64(SLOTS - 1)).astype(np.int64)


def search(w: Words, t: Table) -> tuple[np.ndarray, np.ndarray]:
    """First word and test string of every occurrence, texts not crossed."""
    n, m, b = len(w.start), t.length, t.block
    if n < m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(m - 1, n, LANE)  # where each lane's window ends
    stop = np.minimum(at + LANE, n)
    ends = []
    while len(at):
        jump = t.shift[_slot(chain(w.code, at - b + 1, b))].astype(np.int64)
        ends.append(at[jump == 0])
        at = at + np.maximum(jump, 1)
        on = at < stop
        at, stop = at[on], stop[on]
    first = np.concatenate(ends) - m + 1
    slot = _slot(chain(w.code, first + m - b, b))
    size = t.bucket[slot + 1] - t.bucket[slot]
    place = np.repeat(t.bucket[slot] - np.cumsum(size) + size, size) + np.arange(size.sum())
    first, which = np.repeat(first, size), t.entry[place]
    text = np.searchsorted(w.offsets, first, "right") - 1
    keep = (chain(w.code, first, b) == t.head[which]) & (first + m <= w.offsets[text + 1])
    first, which = first[keep], which[keep]
    for k in range(m):
        keep = w.code[first + k] == t.code[which, k]
        first, which = first[keep], which[keep]
    same = np.fromiter((w.text(f, m) == t.text[i] for f, i in zip(first, which)), bool, len(first))
    return first[same], which[same]


def find(column: pa.Array, found: list[Table]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """Number of words, hit stretches of words (first, end) and items of each text."""
    w = words(*arrow.raw(column))
    cover = np.zeros(len(w.start) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(column))]
    for t in found:
        first, which = search(w, t)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + t.length, -1)
        text = np.searchsorted(w.offsets, first, "right") - 1
        for d, i in set(zip(text.tolist(), which.tolist())):
            items[d].update(t.items[i])
    hit = np.zeros(len(w.start) + 1, bool)
    hit[:-1] = np.cumsum(cover)[:-1] > 0
    before = np.concatenate([[False], hit[:-1]])
    # A stretch ends with its text.
    edge = np.zeros(len(hit), bool)
    edge[w.offsets[:-1]] = True
    begin = np.flatnonzero(hit & (~before | edge))
    end = np.flatnonzero(before & (~hit | edge))
    text = np.searchsorted(w.offsets, begin, "right") - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    for d, a, z in zip(text.tolist(), begin.tolist(), end.tolist()):
        spans[d].append((a - int(w.offsets[d]), z - int(w.offsets[d])))
    return np.diff(w.offsets), spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping stretches as one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's items in blocks of at most BLOCK_BYTES of text (or one item); the driver holds one block."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string"))
    for item, text in rows.where(F.col(text_col).isNotNull()).toLocalIterator():
        n = len(text.encode())
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def scan(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", window: int = WINDOW,
) -> DataFrame:
    """id, n_words, spans (hit stretches of words: first, end) and items (sorted ids) of every document.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. A test string is a window of an
    item's words, or the whole item if it has fewer. The benchmark is broadcast in blocks of bounded size; each further
    block adds its hits to the rows that stream past, so documents are read once and never shuffled. Null and empty
    texts have no words and no hits; items without words are not searched; an item with a null id hits words like any
    other, but has no id to be listed or counted among the items; repeated rows are searched each; other columns are ignored; an empty benchmark hits nothing.
    """
    session = docs.sparkSession
    out = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.expr("CAST(array() AS array<struct<first:bigint,end:bigint>>)").alias("spans"),
        F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    schema = out.schema
    parts = [session.sparkContext.broadcast(tables(b, window)) for b in blocks(benchmark, item_col)]
    for part in parts or [session.sparkContext.broadcast([])]:

        def add(batches: Iterable[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for step in arrow.steps(batches, "text"):
                n, spans, items = find(step.column(1), part.value)
                spans = [merged([(x["first"], x["end"]) for x in a] + b) if a else b for a, b in zip(step.column(3).to_pylist(), spans)]
                items = [sorted({*a, *b}) for a, b in zip(step.column(4).to_pylist(), items)]
                spans = [[{"first": a, "end": z} for a, z in row] for row in spans]
                arrays = [step.column(0), step.column(1), pa.array(n), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "text", "n_words", "spans", "items"])

        out = out.mapInArrow(add, schema)
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of a ``scan``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return scanned.select(
        F.col(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The rows in which no test string occurs, all columns as they are; null and empty texts stay."""
    out = docs
    for block in blocks(benchmark, item_col):
        part = docs.sparkSession.sparkContext.broadcast(tables(block, window))

        def free(batches: Iterable[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            for step in arrow.steps(batches, text_col):
                _, spans, _ = find(arrow.column(step, text_col), part.value)
                yield step.filter(pa.array([not s for s in spans], pa.bool_()))

        out = out.mapInArrow(free, docs.schema)
    return out
