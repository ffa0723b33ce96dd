r"""Web archives (WARC/1.1) of page tables, and capture histories from the archives' indexes.

Archives are written by Spark's text writer, whose commits leave no half-written file when an executor is lost: a row is a
whole record and the line separator is the CRLF that ends it, so that each gzip file is a plain sequence of records. They are
read line by line, and a record is put together by the length in its header, whatever its payload looks like.

Each reading task yields an index of its records in locally sorted runs of bounded size. Runs are dealt by key ranges, and
each range merges the parts of all runs with a loser tree. Ranges are in order, so the histories are in global order.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.lookup import lookup_join
from clickloom.session import materialize, new_path

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Entries of a sorted run; a task with more entries has several runs.
RUN_ENTRIES = 100_000
# Entries a merge holds in memory per run.
PIECE = 2_000
# Entries a key range is meant to have at most.
RANGE_ENTRIES = 500_000

INDEX = (
    "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, record_id string"
)
FIELDS = [part.split()[0] for part in INDEX.split(", ")]


# Writing.


def _digest(html: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hexadecimal digits of the sum become four of the 32 letters."""
    text = F.sha1(html)
    groups = F.expr("sequence(0, 7)")

    def letters(g: Column) -> Column:
        number = F.conv(F.substr(text, g * 5 + 1, F.lit(5)), 16, 10).cast("long")
        parts = [F.shiftright(number, 15 - 5 * k).bitwiseAND(F.lit(31)) for k in range(4)]
        return F.concat(*[F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), (p + 1).cast("int"), F.lit(1)) for p in parts])

    return F.array_join(F.transform(groups, letters), "")


def captures(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, record_type and refers_to for each row.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the least page_id is the response and the
    others revisit it; a null page_id comes last. Rows that share the least page_id as well as the payload are responses all.
    Smaller payloads are responses. A null html is an empty payload. Other columns are ignored.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    marked = rows.withColumn("payload_digest", _digest(F.col("html"))).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    large = marked.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest")
    groups = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    # Only payloads that repeat can have revisits.
    repeated = materialize(groups.where("copies > 1"), "payloads")
    found = lookup_join(marked, repeated, ["payload_digest"], "left", weight="copies")
    revisit = (F.col("copies") > 1) & (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.select(
        *marked.columns,
        F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _header(*lines: tuple[str, Column]) -> Column:
    """Header lines; one whose value is null is left out."""
    parts = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")) for name, value in lines]
    return F.concat(*parts)


def record_id(page_id: Column, digest: Column) -> Column:
    """A name for the record of a page and payload, in the form of a UUID."""
    code = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit(" "), digest))
    return F.regexp_replace(code, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _uri(url: Column) -> Column:
    """The URL with control characters and blanks as percent codes, so that it stays on its header line."""
    odd = [F.lit(chr(c)) for c in [*range(0x21), 0x7F]]
    out = url
    for c, char in zip([*range(0x21), 0x7F], odd):
        out = F.replace(out, char, F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), out).otherwise(url)


def record(captured: Column) -> Column:
    """The text of a WARC record without its last CRLF, for the columns of ``captures``."""
    digest, size = F.col("payload_digest"), F.col("payload_bytes")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}"),
        _header(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", size.cast("string"))),
        F.lit(CRLF),
    )
    revisit = F.col("record_type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(size)
    header = _header(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", record_id(F.col("page_id"), digest)),
        ("WARC-Date", captured),
        ("WARC-Target-URI", _uri(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), digest))),
        ("X-Page-Id", F.col("page_id").cast("string")),
        ("X-Refers-To-Page-Id", F.col("refers_to").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", length.cast("string")),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    return F.concat(F.lit(VERSION + CRLF), header, F.lit(CRLF), http, body, F.lit(CRLF))


def capture_time(page_id: Column) -> Column:
    """A capture time for tables without one: as many seconds after 2000-01-01 as the page number says, within a century."""
    second = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(100 * 365 * 86_400)) + 946_684_800
    return F.date_format(F.timestamp_seconds(second).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(captured: DataFrame, path: str, captured_at: Column | None = None) -> None:
    """Write the rows of ``captures`` as gzip archives into the new folder ``path``, one or more records per page."""
    when = capture_time(F.col("page_id")) if captured_at is None else captured_at
    lines = captured.select(record(when).alias("value"))
    lines.write.option("lineSep", CRLF).option("compression", "gzip").text(path)


# Reading.


def url_key(url: str | None) -> str:
    """Key that sorts pages of a host and its subdomains together: host labels reversed, then path and query.

    A text that is no URL is its own key, and null the empty one.
    """
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname
        port = parts.port
    except ValueError:
        return url
    if not host:
        return url
    standard = {"http": 80, "https": 443}.get(parts.scheme)
    labels = ",".join(reversed(re.sub(r"^www\d*\.", "", host).split(".")))
    return f"{labels}{f':{port}' if port and port != standard else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}"


class _Lines:
    """Bytes of consecutive lines, handed out by line or by length."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self._lines = (line for batch in batches for line in batch.column(0).cast(pa.large_binary()).to_pylist())

    def line(self) -> bytes | None:
        line = next(self._lines, None)
        return None if line is None else line.removesuffix(b"\r")

    def take(self, length: int) -> bytes:
        """``length`` bytes, and then the rest of their last line, which has to be empty."""
        parts, have = [], 0
        while have <= length:
            line = next(self._lines, None)
            if line is None:
                raise ValueError("an archive ends within a record")
            parts += [line, b"\n"]
            have += len(line) + 1
        block = b"".join(parts)
        if block[length:] != CRLF.encode():
            raise ValueError("a record is not as long as its header says")
        return block[:length]


def _headers(lines: _Lines) -> dict[str, str]:
    out = {}
    while line := lines.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
    lines = _Lines(batches)
    while (line := lines.line()) is not None:
        # Empty lines end a record, and there may be more of them.
        if line:
            if not line.startswith(b"WARC/"):
                raise ValueError("a record does not start with its version")
            header = _headers(lines)
            yield header, lines.take(int(header["content-length"]))


def _entry(header: dict[str, str], block: bytes) -> tuple:
    """Index entry of a record; a response's digest and length come from its payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("latin-1").split(CRLF)[1:])}
    said = header["warc-payload-digest"].removeprefix("sha1:")
    size, digest = int(http["content-length"]), said
    if header["warc-type"] == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest != said:
            raise ValueError("a payload does not have its digest")
    url = header.get("warc-target-uri")
    number = [int(header[k]) if k in header else None for k in ("x-page-id", "x-refers-to-page-id")]
    return url_key(url), header["warc-date"], number[0], url, size, digest, header["warc-type"], number[1], header["warc-record-id"]


def order(entry: tuple) -> tuple:
    """What histories are sorted by: key, time, and page; a missing page comes first."""
    return entry[0].encode("utf-8", "surrogatepass"), entry[1], entry[2] is not None, entry[2] or 0


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives in a folder, with ``run`` and ``place`` in their locally sorted run."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary"))
    return lines.mapInArrow(_runs, f"run long, place int, {INDEX}")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number, entries = TaskContext.get().partitionId(), 0, []
    for header, block in _records(batches):
        entries.append(_entry(header, block))
        if len(entries) == RUN_ENTRIES:
            yield _batch(sorted(entries, key=order), run=(task << 32) + number)
            number, entries = number + 1, []
    if entries:
        yield _batch(sorted(entries, key=order), run=(task << 32) + number)


TYPES = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}


def _batch(entries: list[tuple], run: int | None = None) -> pa.RecordBatch:
    columns = [pa.array([e[i] for e in entries], TYPES.get(name, pa.string())) for i, name in enumerate(FIELDS)]
    if run is None:
        return pa.RecordBatch.from_arrays(columns, FIELDS)
    head = [pa.array([run] * len(entries), pa.int64()), pa.array(range(len(entries)), pa.int32())]
    return pa.RecordBatch.from_arrays([*head, *columns], ["run", "place", *FIELDS])


# Merging.


class LoserTree:
    """Merges sorted iterators. An inner node keeps the loser of its match, so each step plays one path to the root."""

    def __init__(self, runs: list[Iterator], key: Callable[[Any], Any]):
        self._runs, self._key = runs, key
        self._heads = [next(r, None) for r in runs]
        self._keys = [None if h is None else key(h) for h in self._heads]
        size = len(runs)
        self._losers = [-1] * size
        # Leaf i plays at (i + size) // 2 and up; the winner so far is kept at node 0.
        winners = [-1] * size + list(range(size))
        for node in range(size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self._losers[node] = (a, b) if self._before(a, b) else (b, a)
        self._losers[0:1] = [winners[1] if size > 1 else 0] if size else []

    def _before(self, a: int, b: int) -> bool:
        x, y = self._keys[a], self._keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def __iter__(self) -> Iterator:
        while self._runs and self._heads[winner := self._losers[0]] is not None:
            yield self._heads[winner]
            head = next(self._runs[winner], None)
            self._heads[winner], self._keys[winner] = head, None if head is None else self._key(head)
            node = (winner + len(self._runs)) // 2
            while node:
                other = self._losers[node]
                if self._before(other, winner):
                    self._losers[node], winner = winner, other
                node //= 2
            self._losers[0] = winner


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs' parts of one key range, kept in a file of the task, as one sorted sequence."""
    with tempfile.TemporaryFile() as store:
        pieces: dict[int, list[tuple[int, int]]] = {}
        for run, entries in _parts(batches):
            start = store.tell()
            pickle.dump(entries, store, pickle.HIGHEST_PROTOCOL)
            pieces.setdefault(run, []).append((entries[0][0], start))
        runs = [_read_back(store, [at for _, at in sorted(parts)]) for _, parts in sorted(pieces.items())]
        out: list[tuple] = []
        for entry in LoserTree(runs, order):
            out.append(entry)
            if len(out) == PIECE:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(run, up to ``PIECE`` (place, …) entries in order), as rows of a run come one after the other."""
    run, entries = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if entries and (row[0] != run or row[1] < entries[-1][0] or len(entries) == PIECE):
                yield run, entries
                entries = []
            run = row[0]
            entries.append(row[1:])
    if entries:
        yield run, entries


def _read_back(store: Any, starts: list[int]) -> Iterator[tuple]:
    for at in starts:
        store.seek(at)
        for entry in pickle.load(store):
            yield entry[1:]


def histories(runs: DataFrame) -> DataFrame:
    """All entries in global order: ``shard`` counts the key ranges, ``place`` the entries of a range.

    Sorted by URL key, capture time and page number. A URL with many captures is split over ranges by time and page, so no
    range depends on how often one URL occurs.
    """
    runs = materialize(runs, "runs")
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ENTRIES))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_first())
    merged = dealt.mapInArrow(_merge, INDEX)
    number = F.monotonically_increasing_id()
    placed = merged.withColumn("shard", F.shiftright(number, 33).cast("int")).withColumn("place", number.bitwiseAND(F.lit((1 << 33) - 1)))
    return materialize(placed, "histories")


def archive_table(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write a table (page_id, url, html) to archives, read them back, and return the capture histories.

    Columns url_key, captured, page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, shard, place.
    Every row gives one record, repeated rows too; an empty table gives no rows. The URL comes back with control characters
    and blanks as percent codes.
    """
    path = new_path(pages.sparkSession, "archives")
    write_archives(captures(pages, least_bytes), path)
    return histories(read_runs(pages.sparkSession, path))
