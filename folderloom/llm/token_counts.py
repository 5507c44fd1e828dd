"""Token counts by overlap resynchronisation: chunks of huge texts are encoded apart and spliced where they agree.

A text longer than ``CHUNK`` characters is given to the library in chunks that overlap, with offsets; the library cuts each chunk
as it would cut any text, so its first tokens may be wrong (it begins in the middle of a word) and its last ones too. Two
neighbours are spliced at a character where both begin a word of the tokenizer, that is one of its pre-tokens or a special
string, and where ``CONFIRM`` tokens on either side are alike in id, offsets and word ends. Such a boundary is stable:

* tokenizers cut words from left to right, each from where the last one ended, with no look back and little look ahead; no token, merge or
  special string reaches over the end of a word. So two cuts with one common boundary agree from there on, up to
  the end of the shorter chunk, and the left chunk is right up to there, as it was in step since its own splice.
* the boundary is no closer to the left chunk's end than the longest special string and ``AHEAD`` characters, so nothing that the left chunk
  could not see has moved it, and no combining character stands there, so normalisation does not reach over it.

Any character can be such a place, in texts without white space as well. If an overlap has none it is doubled, back into the left chunk
and then on with both, until there is one or the text ends. Memory follows the chunk and the longest run without a boundary.
Shorter texts are given to the library whole.

Edge cases: null counts as the empty text (no bytes, no tokens); ties and repeated rows each get their own result; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 15
OVERLAP = 256
#: Tokens on either side of a splice that must be alike; characters that a word's end may depend on beyond it.
CONFIRM, AHEAD = 3, 16
#: Texts given to the library in one call.
BATCH = 16


class Tokens(NamedTuple):
    """Tokens of a chunk; offsets are those of the whole text."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: Whether a token is the first of its word.
    heads: np.ndarray

    def alike(self, i: int, other: Tokens, j: int) -> bool:
        """Whether ``CONFIRM`` tokens before ``i`` here and before ``j`` there are the same, and as many from there on."""
        return all(np.array_equal(a[i - CONFIRM:i + CONFIRM], b[j - CONFIRM:j + CONFIRM]) for a, b in zip(self, other, strict=True))


class Encoder:
    """A tokenizer file of the library, as its defaults treat special strings in texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.margin = AHEAD + max((len(x.content) for x in added), default=0)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def tokens(self, text: str, at: int) -> Tokens:
        """The tokens of a chunk that begins at ``at``."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        offsets = np.array(found.offsets, np.int64).reshape(-1, 2) + at
        # Special strings each begin the count of words anew or have none: a new number or a new special string is a new word.
        words = np.array([-1 if w is None else w for w in found.word_ids], np.int64)
        heads = np.ones(len(words), bool)
        heads[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
        return Tokens(np.array(found.ids, np.int64), offsets[:, 0], offsets[:, 1], heads)


def _splice(text: str, left: Tokens, kept: int, right: Tokens, high: int) -> tuple[int, int] | None:
    """The first stable boundary before ``high`` as token numbers of both sides, of the left one after ``kept``; else None."""
    ours = np.flatnonzero(left.heads & (left.starts < high))
    ours = ours[(ours >= max(kept, CONFIRM)) & (ours <= len(left.ids) - CONFIRM)]
    theirs = np.flatnonzero(right.heads)
    theirs = theirs[(theirs >= CONFIRM) & (theirs <= len(right.ids) - CONFIRM)]
    both, i, j = np.intersect1d(left.starts[ours], right.starts[theirs], return_indices=True)
    for at, a, b in zip(both.tolist(), ours[i].tolist(), theirs[j].tolist(), strict=True):
        if left.alike(a, right, b) and not unicodedata.combining(text[at]):
            return a, b
    return None


def count_by_chunks(encoder: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text; holds the tokens of two chunks at a time."""
    total, start, end = 0, 0, min(chunk, len(text))
    left, kept = encoder.tokens(text[start:end], start), 0  # the first ``kept`` tokens are counted already, or not in step
    while end < len(text):
        width, stop, cut = overlap, min(len(text), end + chunk), None
        while cut is None:
            begin = max(start, end - width)
            right = encoder.tokens(text[begin:stop], begin)
            cut = _splice(text, left, kept, right, end - encoder.margin)
            if cut is None:
                # Widened: further back into the left chunk, and further on with both.
                width *= 2
                if width > end - start:
                    end = min(len(text), end + width)
                    left = encoder.tokens(text[start:end], start)
                    stop = min(len(text), end + chunk)
                    if end == len(text):
                        return total + len(left.ids) - kept
        total += cut[0] - kept
        start, end, left, kept = begin, stop, right, cut[1]
    return total + len(left.ids) - kept


def _counts(path: str, keep: list[str], text: str, chunk: int, overlap: int):
    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            counts, column = np.zeros(batch.num_rows, np.int64), batch.column(text)
            for i in range(0, batch.num_rows, BATCH):
                texts = [t or "" for t in column.slice(i, BATCH).to_pylist()]
                whole = [k for k, t in enumerate(texts) if len(t) <= chunk]
                counts[[i + k for k in whole]] = encoder.counts([texts[k] for k in whole])
                for k, t in enumerate(texts):
                    if len(t) > chunk:
                        counts[i + k] = count_by_chunks(encoder, t, chunk, overlap)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(counts)], names=[*keep, "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 2048,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: bytes, tokens of the vocabulary file at ``path``, and whether they exceed ``limit``."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sized = docs.select(doc_id, text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = sized.mapInArrow(_counts(path, [doc_id, "n_bytes"], text, chunk, overlap),
                               f"`{doc_id}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
