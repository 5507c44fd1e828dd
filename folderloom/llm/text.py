"""Words of UTF-8 texts as arrays: the inner loops that several operators share.

Both word definitions in use are decided by single bytes (all bytes of a character beyond ASCII belong to a word), so
an Arrow column of texts can be cut into words without decoding it. Work goes slab by slab, so that memory follows
``SLAB`` and the longest single text, never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLAB = 1 << 21
BLOCK = 1 << 20

_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~((_byte == 32) | ((_byte >= 9) & (_byte <= 13)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, BLOCK + 1), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= 2 * BLOCK:
            _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null counts as the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets if len(offsets) else np.zeros(1, np.int64)


def slabs(column: pa.Array, limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes; a longer text stands alone."""
    data, offsets = flat(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; ``kind`` tells which bytes belong to words. Words never cross rows."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    inside = kind[data]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    if n:
        edge[0], edge[n] = inside[0], inside[n - 1]
    starts = edge[:n] & inside
    ends = np.zeros(n + 1, bool)
    ends[1:] = edge[1:] & inside
    cuts = offsets[(offsets > 0) & (offsets < n)]
    joined = cuts[inside[cuts] & inside[cuts - 1]] if len(cuts) else cuts
    starts[joined] = True
    ends[joined] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every word: differences of one running polynomial for each block of words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + BLOCK, side="right")))
        n = int(ends[j - 1] - first)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data[first:first + n].astype(np.uint64) + np.uint64(1)) * _power_table(_MULTIPLIER, n)[:n], out=sums[1:])
        s = starts[i:j] - first
        out[i:j] = (sums[ends[i:j] - first] - sums[s]) * _power_table(_INVERSE, n + 1)[s]
        i = j
    return mix(out)


def string_hashes(codes: np.ndarray):
    """For rows of code points: a function that hashes characters i to j of every row."""
    n = codes.shape[1]
    sums = np.zeros((n + 1, len(codes)), np.uint64)
    np.cumsum((codes.T.astype(np.uint64) + np.uint64(1)) * _power_table(_MULTIPLIER, n)[:n, None], axis=0, out=sums[1:])
    inverse = _power_table(_INVERSE, n + 1)
    return lambda i, j: (sums[j] - sums[i]) * inverse[i]


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive word hashes; the caller drops runs that cross rows."""
    n = max(0, len(words) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out *= np.uint64(_MULTIPLIER)
        out += words[k:k + n]
    return mix(out)


def pack(docs: DataFrame, text: str) -> DataFrame:
    """``_row``, a struct of all other columns, and ``_text``: working columns can then clash with no name."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.struct(*others or [F.lit(0).alias("_none")]).alias("_row"), F.col(f"`{text}`").alias("_text"))


def unpack(packed: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return packed.select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
