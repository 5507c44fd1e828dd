"""Line dedup by content-defined chunks of lines, grown from their boundaries.

A line is removed if it lies in a run of several lines of together ``MIN_WORDS`` words or more, or is itself a line of
``LONG_WORDS`` words or more, that also stands, byte for byte, at an earlier place of the corpus: at a smaller doc_id (then
text hash, then place in the text). Lines without a word are no lines of their own; inside a run their bytes count.

1. A rolling hash over the hashes of two lines in a row runs down each text. Wherever it is the smallest of a chunk, that
   is of a shortest run of at least two lines that reaches ``MIN_WORDS`` (from each line on, and up to each line), stands a boundary; a
   long line is a boundary and a chunk by itself. A chunk alone decides where its boundary is, whatever stands around it, so
   equal chunks have equal boundaries however texts are shifted. Boundaries are one line apart where lines have
   ``MIN_WORDS`` words and up to ``MIN_WORDS`` lines apart where they are short.
2. Boundaries whose hash stands at one place of the corpus go: no chunk about them can repeat.
3. About the others the chunks are grown up and down to their lines, and compared by their bytes. All but the first place go.

The chunks cover every line of every longer run and lie within it, so each repeated run is the union of repeated chunks,
wherever it begins and ends. A chunk has at most ``MIN_WORDS`` lines, or two, so a byte is in a bounded number of them.

Moved are first (document, place, hash) rows of boundaries, then the bytes of the chunks about those that repeat. Groups
are made with partial aggregation, and each tells in a bit mask which of ``SALTS`` parts of its key hold rows, so what was found goes back to
the rows by (key, part): a passage that a third of all documents share never meets in one task. Documents meet their few
decisions by (doc_id, hash of the text).

Edge cases: null and empty texts stay as they are; rows alike in doc_id and text count as one document and are cut alike;
a run repeated within a document is removed there too, but for its first place, and of a run that overlaps its own copy (one
line many times over) the part before the overlap stays; of every line removed an earlier copy is kept; a text may become
empty; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folderloom.llm.text import NOT_SPACE, mix, pack, run_hashes, slabs, unpack, word_hashes, word_spans
from folderloom.plans.staging import Stage

LONG_WORDS, MIN_WORDS = 50, 10
#: Parts of a key, one bit of a long each.
SALTS = 64

_LINE = np.arange(256) != 10

#: Which parts of a key hold rows, and these parts as rows again.
_MASK = "bit_or(shiftleft(1L, salt))"
_SALT_LIST = f"explode(filter(sequence(0, {SALTS - 1}), s -> getbit(mask, s) = 1))"


def chunks(data: np.ndarray, offsets: np.ndarray):
    """Arrays (row, first line, last line, hash, boundary) of all chunks by place; arrays (row, hash) of all boundaries by
    place, to which ``boundary`` points; (start, end) of the lines."""
    starts, ends, rows = word_spans(data, offsets, _LINE)
    words, _, _ = word_spans(data, offsets, NOT_SPACE)
    n_words = np.searchsorted(words, ends) - np.searchsorted(words, starts)
    with_word = n_words > 0
    starts, ends, rows, n_words = starts[with_word], ends[with_word], rows[with_word], n_words[with_word]
    n = len(starts)
    hashes, line = word_hashes(data, starts, ends), np.arange(n)
    total = np.concatenate([[0], np.cumsum(n_words)])
    down = np.maximum(line + 1, np.searchsorted(total, total[:-1] + MIN_WORDS) - 1)
    up = np.minimum(line - 1, np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1)
    long = np.flatnonzero(n_words >= LONG_WORDS)
    first, last = np.concatenate([line, up, long]), np.concatenate([down, line, long])
    inside = (first >= 0) & (last < n)
    first, last = first[inside], last[inside]
    alike = rows[first] == rows[last]
    key = np.unique(first[alike] * (n + 1) + last[alike])
    first, last = key // (n + 1), key % (n + 1)
    rolling = np.append(run_hashes(hashes, 2), hashes[-1:])  # the last one begins no chunk of several lines
    found, length, lowest = hashes[first], last - first, first.copy()
    for k in range(1, int(length.max(initial=0)) + 1):
        more = np.flatnonzero(length >= k)
        found[more] = mix(found[more] * np.uint64(31) + hashes[first[more] + k])
        more = more[length[more] > k]
        lower = more[rolling[first[more] + k] < rolling[lowest[more]]]
        lowest[lower] = first[lower] + k
    alone = length == 0
    at, boundary = np.unique(lowest * 2 + alone, return_inverse=True)
    marks = np.where(at % 2 == 1, hashes[at // 2], rolling[at // 2])
    return (rows[first], first, last, found.view(np.int64), boundary.reshape(-1)), (rows[at // 2], marks.view(np.int64)), (starts, ends)


def _within(row: np.ndarray) -> np.ndarray:
    """The place of each entry within its row, if entries are ordered by row."""
    return np.arange(len(row)) - np.searchsorted(row, row)


def _boundaries(batches):
    """A row for each boundary."""
    for batch in batches:
        for i, _, data, offsets in slabs(batch.column("_text")):
            _, (row, marks), _ = chunks(data, offsets)
            take = pa.array(row + i, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(take), batch.column("_print").take(take), pa.array(_within(row), pa.int32()), pa.array(marks)],
                names=["_id", "_print", "place", "hash"])


def _bytes(batches):
    """The bytes of the chunks about the boundaries whose places are listed."""
    for batch in batches:
        wanted = batch.column("places")
        for i, j, data, offsets in slabs(batch.column("_text")):
            (row, first, last, found, boundary), (owner, _), (starts, ends) = chunks(data, offsets)
            places = wanted.slice(i, j - i)
            of = np.repeat(np.arange(j - i), [len(x) for x in places])
            listed = np.zeros(len(owner), bool)
            listed[np.searchsorted(owner, of) + places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = True
            at = np.flatnonzero(listed[boundary])
            take = pa.array(row[at] + i, pa.int64())
            parts = [data[a:b].tobytes() for a, b in zip(starts[first[at]].tolist(), ends[last[at]].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(take), batch.column("_print").take(take), pa.array(_within(row)[at], pa.int32()),
                 pa.array(found[at]), pa.array(parts, pa.binary())], names=["_id", "_print", "place", "hash", "bytes"])


def _cut(batches):
    """Texts without the chunks whose places are listed; a removed line takes the line feed after it along."""
    for batch in batches:
        doomed = batch.column("places").to_pylist()
        texts = batch.column("_text").to_pylist()
        lines, removed = [0 if t is None else t.count("\n") + 1 for t in texts], [0] * len(texts)
        for r in [r for r, x in enumerate(doomed) if x]:
            raw = texts[r].encode()
            data, out, at, line = np.frombuffer(raw, np.uint8), [], 0, 0
            (_, first, last, _, _), _, (starts, ends) = chunks(data, np.array([0, len(data)]))
            for k in sorted(doomed[r]):  # by place, neither first nor last lines go back
                a, b = int(first[k]), int(last[k])
                out.append(raw[at:int(starts[a])])
                at = min(int(ends[b]) + 1, len(raw))
                removed[r] += max(0, b + 1 - max(a, line))
                line = max(line, b + 1)
            texts[r] = b"".join([*out, raw[at:]]).decode()
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), pa.array(texts, pa.string()), pa.array(lines, pa.int32()), pa.array(removed, pa.int32())],
            names=["_row", "_text", "n_lines", "n_removed"])


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with repeated runs of lines cut out of the texts; ``report`` adds n_lines (before) and n_removed."""
    stage = Stage(docs.sparkSession)
    packed = pack(docs, text).withColumn("_print", F.xxhash64("_text"))
    packed = packed.withColumn("_id", F.col(f"_row.`{doc_id}`"))
    kind = docs.schema[doc_id].dataType.simpleString()
    key = f"_id {kind}, _print long"
    who = F.xxhash64("_id", "_print", "place")
    listed = packed.select("_id", "_print", "_text").mapInArrow(_boundaries, f"{key}, place int, hash long")
    listed = stage.keep(listed.withColumn("salt", F.pmod(who, F.lit(SALTS)).cast("int")), "listed")
    repeated = listed.groupBy("hash").agg(F.min(who).alias("_a"), F.max(who).alias("_b"), F.expr(_MASK).alias("mask")).where("_a <> _b")
    repeated = repeated.select("hash", F.expr(_SALT_LIST).alias("salt"))
    candidates = listed.join(repeated.hint("merge"), ["hash", "salt"]).groupBy("_id", "_print").agg(F.collect_set("place").alias("places"))
    same = F.col("d._id").eqNullSafe(F.col("c._id")) & (F.col("d._print") == F.col("c._print"))
    touched = packed.select("_id", "_print", "_text").alias("d").join(candidates.hint("merge").alias("c"), same).select(
        "d._id", "d._print", "_text", "places")
    parts = touched.mapInArrow(_bytes, f"{key}, place int, hash long, bytes binary")
    parts = stage.keep(parts.withColumn("salt", F.pmod(who, F.lit(SALTS)).cast("int")), "parts")
    here = F.struct("_id", "_print", "place")
    first = parts.groupBy("hash", "bytes").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.expr(_MASK).alias("mask")).where(
        ~F.col("first").eqNullSafe(F.col("last"))).select("hash", "bytes", "first", F.expr(_SALT_LIST).alias("salt"))
    doomed = parts.join(first.hint("merge"), ["hash", "bytes", "salt"]).where(~here.eqNullSafe(F.col("first")))
    doomed = stage.keep(doomed.groupBy("_id", "_print").agg(F.collect_set("place").alias("places")), "doomed")
    cut = packed.alias("d").join(doomed.hint("merge").alias("c"), same, "left").select("_row", "_text", "places")
    row = packed.schema["_row"].dataType.simpleString()
    cut = cut.mapInArrow(_cut, f"_row {row}, _text string, n_lines int, n_removed int")
    if report:
        return cut.select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns], "n_lines", "n_removed")
    return unpack(cut, docs, text)
