"""Bytes that repeat earlier documents, found by suffix sorting in shards.

A window is ``length`` bytes of one text. Its minimiser, the least hash of its 20-byte parts, depends on nothing but its
content, so equal windows have equal minimisers and meet in one shard. Only windows whose minimiser occurs in two documents
or more are sent: stretches of text, not single windows. A shard, sorted by minimiser, is worked off in chunks that end where
the minimiser changes; each chunk is one string whose suffixes are put in order with their common prefixes by induced
sorting (``induced``), which gives the classes of equal windows.

What a step of a few hundred texts already shows to repeat is settled before the shuffle, so a passage that many documents
share leaves one stretch a step. Of equal windows in one text only the first is sent; what is found of it holds for the others.
A minimiser that many steps or many windows share is dealt out by window instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm import arrow, induced
from clickloom.llm.words import mix
from clickloom.session import materialize

LENGTH = 50
PART = 20
STEP_BYTES = 2 << 20
# Bytes of a chunk that is sorted at once; one minimiser's stretches stay together.
CHUNK_BYTES = 2 << 20
# Steps, and windows, from which a minimiser counts as frequent, and the most of them that are broadcast (a bound of the list).
FREQUENT = 1024
HEAVY = 1 << 20
MOST_FREQUENT = 1 << 20
# Bits of the broadcast filters (32 MB), and of those of many keys (128 MB at most); they save work and never decide.
FILTER_BITS = 28
MOST_FILTER_BITS = 30
# Bits a key is to have before a filter gets more of them.
KEY_BITS = 8

_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIERS[0])


def _sums(data: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4, 8 and 16 bytes from each position on."""
    out, width = {1: _BYTE[data]}, 1
    for m in _MULTIPLIERS[:4]:
        x = out[width]
        width *= 2
        out[width] = x[: max(len(x) - width // 2, 0)] * m + x[width // 2 :]
    return out


def _join(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """Hash of a part and the part that starts ``gap`` bytes later."""
    n = max(min(len(a), len(b) - gap), 0)
    return a[:n] * _MULTIPLIERS[4] + b[gap : gap + n]


def _minimisers(data: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Minimiser of each window by its start, texts not regarded, and, if asked for, the hash of the window itself."""
    h = _sums(data)
    part = mix(_join(h[16], h[4], 16))
    n, width = LENGTH - PART + 1, 1
    least = part
    while width * 2 <= n:
        least = np.minimum(least[: max(len(least) - width, 0)], least[width:])
        width *= 2
    rest = n - width
    least = np.minimum(least[: max(len(least) - rest, 0)], least[rest:]) if rest else least
    if not whole:
        return least, None
    three = _join(_join(h[16], h[16], 16), h[16], 32)
    return least, mix(_join(three, h[2], 48))


def _windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and text of all windows that lie inside a text."""
    size = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    return np.arange(len(text)) + (offsets[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]))[text], text


def _has(bits: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whether both places of each key are set."""
    a, width = a.astype(np.uint64, copy=False), len(bits).bit_length() + 2
    found = _set(bits, a, width)
    found[found] = _set(bits, a[found] >> np.uint64(width), width)
    return found


def _set(bits: np.ndarray, a: np.ndarray, width: int) -> np.ndarray:
    at = (a & np.uint64((1 << width) - 1)).view(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def _filter(rows: DataFrame, key: str | Column, keys: int = 0) -> np.ndarray:
    """Bitmap with two places for each of about ``keys`` keys; the driver gets MOST_FILTER_BITS bits at most.

    Places are the last bits of a key and those before. The first bits of a minimiser, a least hash, are nearly always 0:
    a bitmap by them would be full in one corner long before the rest.
    """
    width = FILTER_BITS
    while keys * KEY_BITS > 1 << width and width < MOST_FILTER_BITS:
        width += 1
    key = F.col(key) if isinstance(key, str) else key
    places = [F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << width) - 1)) + 1 for shift in (0, width)]  # bitmaps count from 1
    at = F.col("at")
    found = rows.select(F.explode(F.array(*places)).alias("at")).groupBy(F.bitmap_bucket_number(at).alias("b"))
    found = found.agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    bits = np.zeros(1 << (width - 3), np.uint8)
    for r in found.toLocalIterator():
        chunk = np.frombuffer(bytes(r.bits), np.uint8)
        begin = (r.b - 1) * len(chunk)
        bits[begin : begin + len(chunk)] |= chunk[: len(bits) - begin]
    return bits


def _row_key() -> Column:
    return F.xxhash64("id", "code")


def _steps(batches: Iterable[pa.RecordBatch], firsts: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Steps without texts that are surely later copies, as (rows, bytes, offsets)."""
    for step in arrow.steps(batches, "text", STEP_BYTES):
        step = step.filter(pa.array(_has(firsts, np.asarray(arrow.column(step, "key")))))
        if step.num_rows:
            yield step, *arrow.raw(arrow.column(step, "text"))


def _runs(changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run; ``changed`` tells where one begins."""
    first = np.flatnonzero(changed)
    return first, np.append(first[1:], len(changed)) - 1


def _seen(docs: DataFrame, firsts) -> DataFrame:
    """(h, id, windows): each step's minimisers with the least and the greatest document of the step that has them.

    The row of the least document counts the minimiser's windows in the step.
    """

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, data, offsets in _steps(batches, firsts.value):
            least, _ = _minimisers(data)
            start, text = _windows(offsets)
            if not len(start):
                continue
            h = least[start]
            at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]))
            many = np.diff(np.append(at, len(h)))
            h, ids = h[at], np.asarray(arrow.column(step, "id"))[text[at]]
            order = np.argsort(h)
            h, ids = h[order], ids[order]
            first, _ = _runs(np.concatenate([[True], h[1:] != h[:-1]]))
            h, low, high = h[first].astype(np.int64), np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
            more = high > low
            many = np.concatenate([np.add.reduceat(many[order], first), np.zeros(more.sum(), np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h, h[more]])), pa.array(np.concatenate([low, high[more]])), pa.array(many)], ["h", "id", "windows"]
            )

    return docs.mapInArrow(emit, "h long, id long, windows int")


STRETCHES = "h long, stretch binary, id long, code long, first int, end int"


def _binary(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - first
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def _stretches(docs: DataFrame, firsts, shared, frequent) -> DataFrame:
    """Stretches whose windows have a minimiser that two documents share, and covers already settled (without stretch)."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in STRETCHES.split(", ")]
        for step, data, offsets in _steps(batches, firsts.value):
            least, whole = _minimisers(data, whole=True)
            start, text = _windows(offsets)
            keep = _has(shared.value, least[start]) if len(start) else np.zeros(0, bool)
            start, text = start[keep], text[keep]
            if not len(start):
                continue
            ids, codes = (np.asarray(arrow.column(step, c)) for c in ("id", "code"))
            h, window, own = least[start], whole[start], ids[text]
            order = np.lexsort((own, window))
            first, _ = _runs(np.concatenate([[True], window[order][1:] != window[order][:-1]]))
            low = np.empty(len(start), np.int64)
            low[order] = np.repeat(own[order][first], np.diff(np.append(first, len(start))))
            settled = own > low
            # The sort is stable, so of equal windows in a text the first comes first.
            again = np.zeros(len(start), bool)
            again[order[1:]] = (window[order[1:]] == window[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
            send = settled | ~again
            start, text, h, window, settled = start[send], text[send], h[send], window[send], settled[send]
            often = frequent.value
            spread = often[np.minimum(np.searchsorted(often, h), len(often) - 1)] == h if len(often) else np.zeros(len(h), bool)
            shard = np.where(spread, window, h)
            next_to = (start[1:] == start[:-1] + 1) & (text[1:] == text[:-1]) & (settled[1:] == settled[:-1])
            # Settled windows are joined to covers whatever their minimiser; other stretches have one shard each.
            next_to &= settled[1:] | (shard[1:] == shard[:-1])
            a, z = _runs(np.concatenate([[True], ~next_to]))
            begin, end, who, done = start[a], start[z] + LENGTH, text[a], settled[a]
            for pick in (~done, done):
                b, e, w, s = begin[pick], end[pick], who[pick], shard[a][pick].astype(np.int64)
                stretch = pa.nulls(len(b), pa.binary()) if pick is done else _binary(data, b, e)
                if pick is done:
                    s = s ^ codes[w]
                base = offsets[:-1][w]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s), stretch, pa.array(ids[w]), pa.array(codes[w]), pa.array((b - base).astype(np.int32)), pa.array((e - base).astype(np.int32))],
                    names,
                )

    return docs.mapInArrow(emit, STRETCHES)


def _classes(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Covers (id, code, first, end) of windows of some stretches that a stretch of a lesser document has too.

    Equal stretches are sorted once, with the least of their documents; a minimiser whose stretches are all equal needs
    no sorting.
    """
    # Wide offsets: a group of more than 2 GB stays one array.
    kinds = arrow.column(rows, "stretch").cast(pa.large_binary()).dictionary_encode()
    kind, raw = np.asarray(kinds.indices).astype(np.int64), kinds.dictionary
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    h, ids, codes, begin = (np.asarray(arrow.column(rows, c)) for c in ("h", "id", "code", "first"))
    low = np.full(len(raw), np.iinfo(np.int64).max)
    np.minimum.at(low, kind, ids)
    shard = np.empty(len(raw), np.int64)
    shard[kind] = h
    _, member, many = np.unique(shard, return_inverse=True, return_counts=True)
    mixed = many[member] > 1
    least = np.repeat(low, np.diff(offsets))
    if mixed.any():
        _lower(data, offsets, mixed, least)
    # Windows of all rows, by the place of the same window in its kind.
    size = np.diff(offsets)[kind] - LENGTH + 1
    row = np.repeat(np.arange(len(kind)), size)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    gone = least[offsets[:-1][kind[row]] + inside] < ids[row]
    row, inside = row[gone], inside[gone]
    a, z = _runs(np.concatenate([[True], (inside[1:] != inside[:-1] + 1) | (row[1:] != row[:-1])])) if len(row) else (row, row)
    who = row[a]
    b, e = begin[who] + inside[a], begin[who] + inside[z] + LENGTH
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[who]), pa.array(codes[who]), pa.array(b.astype(np.int32)), pa.array(e.astype(np.int32))], ["id", "code", "first", "end"]
    )


def _lower(data: np.ndarray, offsets: np.ndarray, mixed: np.ndarray, least: np.ndarray) -> None:
    """Lower ``least``, the least document of each window by its start, to that of all equal windows of mixed stretches."""
    size = np.diff(offsets)[mixed]
    inner = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(inner[-1]) + np.repeat(offsets[:-1][mixed] - inner[:-1], size)
    order, common = induced.suffixes(data[at], LENGTH)
    start, _ = _windows(inner)
    window = np.zeros(len(at), bool)
    window[start] = True
    group = np.cumsum(common < LENGTH)
    keep = window[order]
    order, group = order[keep], group[keep]
    own = least[at[order]]
    first, _ = _runs(np.concatenate([[True], group[1:] != group[:-1]]))
    least[at[order]] = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(own))))


def _whole(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """All rows as one batch, whatever their bytes: narrow offsets would leave several batches beyond 2 GB."""
    table = pa.Table.from_batches(rows)
    at = table.schema.get_field_index("stretch")
    table = table.set_column(at, "stretch", table.column(at).cast(pa.large_binary())).combine_chunks()
    (batch,) = table.to_batches()
    return batch


def _covers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covers of a shard sorted by minimiser, chunk by chunk."""
    held: list[pa.RecordBatch] = []
    size = 0

    def chunk(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        return _classes(_whole(rows))

    for batch in batches:
        sent = arrow.column(batch, "stretch").is_valid()
        settled = batch.filter(pc.invert(sent))
        if settled.num_rows:
            yield settled.select(["id", "code", "first", "end"])
        batch = batch.filter(sent)
        while batch.num_rows:
            h = np.asarray(arrow.column(batch, "h"))
            total = np.cumsum(np.asarray(pc.binary_length(arrow.column(batch, "stretch"))))
            # The chunk ends with the first minimiser that reaches its size.
            full = int(np.searchsorted(total, CHUNK_BYTES - size))
            cut = batch.num_rows if full >= batch.num_rows else int(np.searchsorted(h, h[full], "right"))
            if held and size >= CHUNK_BYTES:
                cut = int(np.searchsorted(h, last, "right"))
                if cut == 0:
                    yield chunk(held)
                    held, size = [], 0
                    continue
            held.append(batch.slice(0, cut))
            size += int(total[cut - 1])
            last = h[cut - 1]
            if cut < batch.num_rows:
                yield chunk(held)
                held, size = [], 0
            batch = batch.slice(cut)
    if held:
        yield chunk(held)


def _result(batch: pa.RecordBatch, covers: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    """Digest of each text without its covers."""
    data, offsets = arrow.raw(arrow.column(batch, "text"))
    removed, spans, sha = [], [], []
    for k, cover in enumerate(covers):
        kept, gone, n, at = hashlib.sha256(), 0, 0, 0
        text = data[offsets[k] : offsets[k + 1]]
        for a, z in _merged(cover):
            kept.update(text[at:a].tobytes())
            gone, n, at = gone + z - a, n + 1, z
        kept.update(text[at:].tobytes())
        removed.append(gone)
        spans.append(n)
        sha.append(kept.hexdigest())
    return pa.RecordBatch.from_arrays(
        [arrow.column(batch, "id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
        ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def _everywhere(batch: pa.RecordBatch, covers: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Covers of each text with those of all windows that equal a covered one of the same text."""
    data, offsets = arrow.raw(arrow.column(batch, "text"))
    out = []
    for k, cover in enumerate(covers):
        text = data[offsets[k] : offsets[k + 1]]
        n = len(text) - LENGTH + 1
        if not cover or n < 1:
            out.append(cover)
            continue
        # A cover consists of windows that are covered themselves; one across two covers need not be.
        step = np.zeros(n + 1, np.int64)
        for a, z in cover:
            step[a] += 1
            step[z - LENGTH + 1] -= 1
        whole = _minimisers(text, whole=True)[1][:n]
        gone = np.isin(whole, whole[np.cumsum(step[:n]) > 0])
        at = np.flatnonzero(gone)
        a, z = _runs(np.concatenate([[True], np.diff(at) > 1]))
        out.append(list(zip(at[a].tolist(), (at[z] + LENGTH).tolist())))
    return out


def _merged(cover: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching covers are one span."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(cover):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, object]:
    """Texts with their keys; covers (id, code, first, end) of bytes that repeat; the filter of texts that are no copies."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("code", F.xxhash64("text")).withColumn("key", _row_key())
    context = docs.sparkSession.sparkContext
    known = texts.where("id IS NOT NULL")
    # A text's first document stands for all its copies: it has all their windows and the least id.
    first = known.select("id", "code").groupBy("code").agg(F.min("id").alias("id"))
    firsts = context.broadcast(_filter(first, _row_key()))
    seen = _seen(known, firsts).repartition("h").groupBy("h")
    seen = seen.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"), F.sum("windows").alias("windows"))
    met = materialize(seen.where("low < high").select("h", "n", "windows"), "shared")
    shared = context.broadcast(_filter(met, "h", met.count()))
    often = met.where((F.col("n") >= FREQUENT) | (F.col("windows") >= HEAVY)).orderBy(F.desc("windows"), "h").limit(MOST_FREQUENT).select("h").toArrow()
    frequent = context.broadcast(np.sort(often.column("h").to_numpy().astype(np.uint64)))
    sent = _stretches(known, firsts, shared, frequent).repartition("h").sortWithinPartitions("h")
    found = sent.mapInArrow(_covers, "id long, code long, first int, end int")
    return texts, materialize(found, "covers"), firsts


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A byte is removed if it lies in LENGTH bytes of its text's UTF-8 that also start in a document with a lesser id; all
    strings are judged on the input. Ids are integers. Null is the empty text; texts shorter than LENGTH keep all; rows
    with the same id do not remove from each other, each text is judged apart; rows with a null id keep all and remove
    nothing; other columns are ignored; an empty table gives an empty one. Equal texts and the windows settled before the
    shuffle are compared by 64-bit hashes, and so are equal windows inside one text; all others byte by byte.
    """
    texts, found, firsts = covers(docs, id_col, text_col)
    touched = docs.sparkSession.sparkContext.broadcast(_filter(found.select("id", "code").distinct(), _row_key()))

    def copies(step: pa.RecordBatch) -> np.ndarray:
        known = np.asarray(arrow.column(step, "id").is_valid())
        return known & ~_has(firsts.value, np.asarray(arrow.column(step, "key")))

    def untouched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in arrow.steps(batches, "text", STEP_BYTES):
            copy = copies(step)
            keep = copy | ~_has(touched.value, np.asarray(arrow.column(step, "key")))
            step, copy = step.filter(pa.array(keep)), copy[keep]
            sizes = np.diff(arrow.raw(arrow.column(step, "text"))[1])
            yield _result(step, [[(0, n)] if c and n >= LENGTH else [] for c, n in zip(copy.tolist(), sizes.tolist())])

    def maybe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in arrow.steps(batches, "text", STEP_BYTES):
            yield step.filter(pa.array(~copies(step) & _has(touched.value, np.asarray(arrow.column(step, "key")))))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in arrow.steps(batches, "text", STEP_BYTES):
            lists = [[(c["first"], c["end"]) for c in row or []] for row in arrow.column(step, "covers").to_pylist()]
            yield _result(step, _everywhere(step, lists))

    lists = found.groupBy("id", "code").agg(F.collect_list(F.struct("first", "end")).alias("covers"))
    hit = texts.mapInArrow(maybe, texts.schema)
    # A null id has no cover, but may pass the filter.
    joined = hit.join(lists, ["id", "code"], "left").select("id", "text", "covers")
    out = texts.mapInArrow(untouched, RESULT).unionByName(joined.mapInArrow(cut, RESULT))
    return out.withColumnRenamed("id", id_col)
