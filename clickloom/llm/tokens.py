"""Token counts of whole texts, without keeping any token.

A text is cut at blanks and line feeds. No pre-token of the tokenizer crosses them, so its count is the sum over the
pieces. Each batch is balanced by bytes; its distinct pieces are encoded once and the counts are kept for the task's
later batches (a cache of fixed size that only saves time).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import arrow

# Distinct pieces a task remembers before it starts anew.
REMEMBERED = 1_000_000
# Bytes of text per step: large enough for pieces to repeat.
STEP_BYTES = 16 << 20
# Letters in front of full stops or commas that end a piece: the cut between them is a pre-token boundary.
TAIL = r"([A-Za-z])([.,]+)([ \n]|$)"


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _pieces(text: pa.Array) -> pa.ListArray:
    """Each text's pieces: cut at blanks and line feeds, closing stops apart. Case stays: special strings depend on it."""
    text = pc.replace_substring_regex(text, TAIL, r"\1 \2\3")
    return pc.split_pattern_regex(text, r"[ \n]")


def _lengths(pieces: list[str], path: str, known: dict[str, int]) -> np.ndarray:
    new = [p for p in pieces if p not in known]
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = pieces
    for at in range(0, len(new), 4096):
        part = new[at : at + 4096]
        known.update(zip(part, map(len, _tokenizer(path).encode_batch_fast(part, add_special_tokens=False))))
    return np.fromiter((known[p] for p in pieces), np.int64, len(pieces))


def lengths(text: pa.Array, path: str, known: dict[str, int]) -> np.ndarray:
    """Number of tokens of each text."""
    lists = _pieces(arrow.texts(text))
    offsets = np.asarray(lists.offsets, np.int64)
    flat = lists.values.dictionary_encode()
    each = _lengths(flat.dictionary.to_pylist(), path, known)
    return arrow.sums(each[np.asarray(flat.indices)], offsets) if len(flat) else np.zeros(len(text), np.int64)


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``path`` is a vocabulary file of the ``tokenizers`` library whose pre-tokenizer never crosses white space; every
    executor has it. No special token is added; special strings inside a text are handled as the library does by
    default. Null and empty texts have 0 tokens, repeated rows are counted each, other columns are ignored, an empty
    table gives an empty table.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for step in arrow.steps(batches, "text", STEP_BYTES):
            _, offsets = arrow.raw(step.column(1))
            n = lengths(step.column(1), path, known)
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
