"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds whole documents in ascending doc_id order:

* data frames: independent zstandard frames of at most ``FRAME`` bytes of ids (little-endian unsigned 32-bit, each document
  closed by the end id). A document may run over frames, a frame may hold many documents;
* the document table: a skippable frame (magic 0x184D2A50) with a zstandard frame of ids, validity and token counts;
* the seek table of the public seekable format: a skippable frame (magic 0x184D2A5E) with compressed size, size and the low 32
  bits of XXH64 of each frame before it, closed by the number of frames, a descriptor and the magic 0x8F92EAB1;
* an empty skippable frame of 8 bytes.

All of it is plain zstandard: any decoder gives all ids in order. A reader that wants some documents reads the two tables at
the end, then decompresses and checks only the frames these documents lie in.

Writing: documents are dealt out by ranges of (doc_id, hash of the text), sorted, encoded in Arrow batches, and each file of
about ``FILE`` bytes of ids is one row of bytes. Spark's text writer stores the rows, one a file; the empty skippable frame is
its line separator. So files are committed like any other Spark output: no half-written file is ever seen, a lost executor
costs its tasks only, and every file system Spark knows will do. Memory follows ``FILE`` and the longest document.

``start`` of a document counts the ids of all documents before it, over all files: files are summed within each writing task,
and the tasks' totals are summed in one small window. These sums are kept as ``files``, a table with one row per file, with
the first and last doc_id of each, by which a lookup picks the files it opens.

The library's own result is kept exactly, at less cost: between two characters that are not white space, a single space is
always a border of the byte-level pre-tokenizer, and no token crosses one. Runs between such spaces are encoded once each by the
library and remembered, up to ``MEMO``; a slab of texts is cut, its distinct runs are looked up and their ids gathered in whole
columns. Texts with other spacing are cut by a pattern that finds the same borders.

Edge cases: null counts as the empty text, whose only id is the end id; rows without doc_id come first; rows that share a
doc_id stand side by side, by a hash of their text; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folderloom.llm.text import flat
from folderloom.plans.staging import Stage

FILE, FRAME = 32 << 20, 256 << 10
LEVEL = 1
#: Runs of characters kept by one Python worker, of at most ``LONG`` characters each.
MEMO, LONG = 500_000, 64
GROUP, PIECE, SLAB = 256, 1 << 20, 8 << 20

# Fixed values of the zstandard and seekable formats.
TABLE_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
EMPTY_FRAME = struct.pack("<II", TABLE_MAGIC, 0)

#: Wider than the pre-tokenizer's own white space, so that a border is never claimed where there may be none.
_GAP = r"\s᠎﻿"
_BORDER = re.compile(f"(?<=[^{_GAP}]) (?=[^{_GAP}])")
_SPACES = frozenset(re.findall(f"[{_GAP}]", "".join(map(chr, range(0x10000)))))
#: A mark of its own at the end of a run: behind a letter of the Latin alphabets it is always a token run of its own.
_MARKS = frozenset(",.;:!?)")
_LATIN = frozenset(c for c in map(chr, range(0x250)) if c.isalpha())


def _edged(run: str) -> bool:
    """Whether a space before or after the run may not be a border."""
    return not run or run[0] in _SPACES or run[-1] in _SPACES


@cache
def encoder(path: str, end: int | None) -> Encoder:
    """One for each Python worker, which Spark keeps from task to task."""
    return Encoder(path, end)


class Encoder:
    """Ids of texts as bytes, by the tokenizers library."""

    def __init__(self, path: str, end: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = b"" if end is None else np.uint32(end).tobytes()
        self.memo: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        for token, i in vocabulary.items():
            self.starts[i] = token.startswith(space)
        self.marks = {m: ids.tobytes() for m, ids in zip(_MARKS, self._whole(list(_MARKS)), strict=True)}

    def _whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _learn(self, runs: set[str]) -> None:
        """Ids of runs that follow a space; of "word," they are those of "word" and of the comma."""
        marked = [r for r in runs if r[-1] in _MARKS and r[-2:-1] in _LATIN]
        plain = runs.difference(marked)
        plain.update(r[:-1] for r in marked)
        self._plain(list(plain.difference(self.memo)))
        memo = self.memo
        memo.update((r, memo[r[:-1]] + self.marks[r[-1]]) for r in marked)

    def _plain(self, runs: list[str]) -> None:
        """Many runs are given to the library as one text: each starts at an id that holds a space."""
        for at in range(0, len(runs), GROUP):
            some = runs[at:at + GROUP]
            ids = self._whole([" " + " ".join(some)])[0]
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) == len(some) and cuts[0] == 0:
                data = ids.tobytes()
                bounds = [*(cuts * 4).tolist(), len(data)]
                self.memo.update((run, data[a:b]) for run, a, b in zip(some, bounds, bounds[1:], strict=False))
            else:
                self._apart(some)

    def _apart(self, runs: list[str]) -> None:
        self.memo.update((run, x.tobytes()) for run, x in zip(runs, self._whole([" " + r for r in runs]), strict=True))

    def _tails(self, tails: list[list[str]]) -> list[bytes]:
        """The ids of lists of runs, each of which follows a space; those with white space in or around them are not kept."""
        self._trim()
        new = set().union(*tails).difference(self.memo)
        passing = {r for r in new if len(r) > LONG or " " in r or _edged(r)}
        self._learn(new.difference(passing))
        self._apart(list(passing))
        out = [b"".join(map(self.memo.__getitem__, t)) for t in tails]
        for r in passing:
            del self.memo[r]
        return out

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text with the end id, as bytes; slab by slab, a long text alone."""
        _, offsets = flat(column)
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLAB, side="right")) - 1)
            yield from self._slab(pc.fill_null(column.slice(i, j - i).cast(pa.large_string()), ""))
            i = j

    def _slab(self, texts: pa.Array) -> Iterator[bytes]:
        """All texts are cut at single spaces at once, distinct runs looked up, and their ids gathered for every place they stand at."""
        if len(texts) == 1 and len(texts[0].as_py()) > PIECE:
            yield b"".join(self._long(texts[0].as_py())) + self.end
            return
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(cut.flatten())
        codes, runs = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        bounds = bounds - bounds[0]
        edged = np.fromiter(map(_edged, runs), bool, len(runs))
        odd = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(edged[codes], out=odd[1:])
        odd = odd[bounds[1:]] > odd[bounds[:-1]]  # texts with a space that may be no border
        first = codes[bounds[:-1]]
        ids = self._known([r if not e else "" for r, e in zip(runs, edged.tolist(), strict=True)])
        pool = np.frombuffer(b"".join(ids), np.uint32)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(lengths) - lengths
        size = lengths[codes]
        size[bounds[:-1]] = 0  # nothing stands before the first run of a text, which so has other ids
        ends = np.concatenate([[0], np.cumsum(size)])
        gathered = pool[np.repeat(starts[codes] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        places = (ends[bounds] * 4).tolist()
        heads = self._whole([runs[k] for k in first])
        slow = iter(self._borders([texts[int(k)].as_py() for k in np.flatnonzero(odd)]))
        for k, head in enumerate(heads):
            yield (next(slow) if odd[k] else head.tobytes() + gathered[places[k]:places[k + 1]]) + self.end

    def _known(self, runs: list[str]) -> list[bytes]:
        """The ids of distinct runs that follow a space each; the empty run has none."""
        self._trim()
        found = list(map(self.memo.get, runs))
        new = {r for r, x in zip(runs, found, strict=True) if x is None and r}
        passing = {r for r in new if len(r) > LONG}
        self._learn(new.difference(passing))
        self._apart(list(passing))
        found = [x if x is not None else self.memo[r] if r else b"" for r, x in zip(runs, found, strict=True)]
        for r in passing:
            del self.memo[r]
        return found

    def _trim(self) -> None:
        if len(self.memo) > MEMO:  # the first to come are the most frequent ones
            self.memo = dict(islice(self.memo.items(), MEMO // 4))

    def _borders(self, texts: list[str]) -> list[bytes]:
        """Texts with other spacing, cut by the pattern."""
        cut = [_BORDER.split(t) for t in texts]
        heads = self._whole([c.pop(0) for c in cut])
        return [h.tobytes() + t for h, t in zip(heads, self._tails(cut), strict=True)]

    def _long(self, text: str) -> Iterator[bytes]:
        """A long text piece by piece, each ended by a border."""
        at = 0
        while at < len(text):
            border = _BORDER.search(text, at + PIECE)
            runs = _BORDER.split(text[at:border.start() if border else len(text)])
            if at == 0:
                yield self._whole([runs.pop(0)])[0].tobytes()
            yield self._tails([runs])[0]
            at = border.end() if border else len(text)


def file_bytes(docs: list[tuple[int | None, bytes]], frame: int = FRAME, level: int = LEVEL) -> bytes:
    """One file of (doc_id, ids), without the empty frame at its end."""
    compressor = zstandard.ZstdCompressor(level=level)
    out, entries, held, size = [], [], [], 0

    def close() -> None:
        nonlocal size
        raw = b"".join(held)
        out.append(compressor.compress(raw))
        entries.append((len(out[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        held.clear()
        size = 0

    for _, ids in docs:
        at = 0
        while at < len(ids):
            part = ids[at:at + frame - size]
            held.append(part)
            size, at = size + len(part), at + len(part)
            if size == frame:
                close()
    if held:
        close()
    numbers = np.array([d if d is not None else 0 for d, _ in docs], "<i8")
    known = np.array([d is not None for d, _ in docs], np.uint8)
    lengths = np.array([len(ids) // 4 for _, ids in docs], "<i8")
    table = compressor.compress(numbers.tobytes() + lengths.tobytes() + known.tobytes())
    out.append(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
    entries.append((len(out[-1]), 0, xxhash.xxh64_intdigest(table) & 0xFFFFFFFF))
    seek = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), CHECKSUMS, FOOTER_MAGIC)
    return b"".join([*out, struct.pack("<II", SEEK_MAGIC, len(seek)), seek])


class TokenFile:
    """Documents of one file; ``fetch(at, n)`` gives n bytes of it, so only what is asked for is read and decompressed."""

    def __init__(self, size: int, fetch: Callable[[int, int], bytes]):
        self.fetch, self.frames_read = fetch, 0
        self.decompressor = zstandard.ZstdDecompressor()
        end = size - len(EMPTY_FRAME) if fetch(size - len(EMPTY_FRAME), len(EMPTY_FRAME)) == EMPTY_FRAME else size
        n, flags, magic = struct.unpack("<IBI", fetch(end - 9, 9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table")
        entries = np.frombuffer(fetch(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.checksums, self.sizes = entries[:, 2], entries[:, 0]
        self.at = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(entries[:-1, 1])])  # first byte of ids of each data frame, and their sum
        table = fetch(int(self.at[n - 1]) + 8, int(entries[n - 1, 0]) - 8)
        if xxhash.xxh64_intdigest(table) & 0xFFFFFFFF != self.checksums[n - 1]:
            raise ValueError("the document table is damaged")
        raw = self.decompressor.decompress(table)
        m = len(raw) // 17
        self.known = np.frombuffer(raw, np.uint8, m, 16 * m).astype(bool)
        self.doc_ids, self.lengths = np.frombuffer(raw, "<i8", m), np.frombuffer(raw, "<i8", m, 8 * m)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    @classmethod
    def of(cls, content: bytes) -> TokenFile:
        return cls(len(content), lambda at, n: content[at:at + n])

    def frame(self, k: int) -> bytes:
        raw = self.decompressor.decompress(self.fetch(int(self.at[k]), int(self.sizes[k])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checksums[k]:
            raise ValueError(f"frame {k} is damaged")
        self.frames_read += 1
        return raw

    def documents(self, wanted: Sequence[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(place in the file, ids) of the documents at the wanted places, ascending; each frame is opened once at most."""
        k, raw = -1, b""
        for d in range(len(self.lengths)) if wanted is None else wanted:
            low, high, parts = 4 * int(self.starts[d]), 4 * int(self.starts[d + 1]), []
            while low < high:
                inside = int(np.searchsorted(self.first, low, side="right")) - 1
                if inside != k:
                    k, raw = inside, self.frame(inside)
                begin = low - int(self.first[k])
                parts.append(raw[begin:begin + high - low])
                low += len(parts[-1])
            yield d, b"".join(parts)


def _files(path: str, end: int | None, limit: int, frame: int):
    def run(batches):
        encode, held, size = encoder(path, end).texts, [], 0
        for batch in batches:
            numbers = batch.column("doc_id").to_pylist()
            for number, ids in zip(numbers, encode(batch.column("text")), strict=True):
                held.append((number, ids))
                size += len(ids)
                if size >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array([file_bytes(held, frame)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([file_bytes(held, frame)], pa.binary())], names=["value"])

    return run


def _contents(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> DataFrame:
    paths = f"{folder}/ids" if names is None else [f"{folder}/ids/{n}" for n in names]
    files = spark.read.format("binaryFile").load(paths).where("length > 0")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _summaries(batches):
    for batch in batches:
        for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            f = TokenFile.of(content.as_py())
            known = f.doc_ids[f.known]
            span = [pa.array([int(x) if len(known) else None], pa.int64()) for x in ((known[0], known[-1]) if len(known) else (0, 0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), *span, pa.array([not f.known.all()]), pa.array([len(f.lengths)], pa.int64()), pa.array([int(f.starts[-1])], pa.int64())],
                names=["file", "first_doc", "last_doc", "unnamed", "n_docs", "n_ids"])


_FILES = "file string, first_doc long, last_doc long, unnamed boolean, n_docs long, n_ids long, start long"


def write(docs: DataFrame, folder: str, path: str, end: int | None = 0, doc_id: str = "doc_id", text: str = "text",
          file_size: int = FILE, frame: int = FRAME) -> DataFrame:
    """Write ``folder``/ids and ``folder``/files; returns the table of files."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    stored = rows.select("doc_id", "text").mapInArrow(_files(path, end, file_size, frame), "value binary")
    stored.select(F.col("value").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode("ascii")).option(
        "maxRecordsPerFile", 1).text(f"{folder}/ids")
    found = _contents(spark, folder).mapInArrow(_summaries, _FILES.removesuffix(", start long"))
    task, turn = (F.regexp_extract("file", p, 1).cast("long") for p in (r"^part-(\d+)", r"-c(\d+)\.[^-]*$"))
    found = found.withColumns({"_task": task, "_turn": turn})
    within = F.sum("n_ids").over(Window.partitionBy("_task").orderBy("_turn")) - F.col("n_ids")
    staged = Stage(spark).keep(found.withColumn("_within", within), "files")
    totals = staged.groupBy("_task").agg(F.sum("n_ids").alias("_n"))  # one row per writing task
    bases = totals.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_base"))
    named = staged.join(bases, "_task").withColumn("start", F.col("_base") + F.col("_within"))
    named.select(*[f.split()[0] for f in _FILES.split(", ")]).write.parquet(f"{folder}/files")
    return spark.read.schema(_FILES).parquet(f"{folder}/files")


def _documents(doc_ids: Sequence[int] | None, slab: int = 4 << 20):
    wanted = None if doc_ids is None else np.array(sorted(set(doc_ids)), np.int64)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["file", "doc_id", "_within", "n_tokens", "ids"]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                f, rows, size = TokenFile.of(content.as_py()), [], 0
                places = None if wanted is None else np.flatnonzero(f.known & np.isin(f.doc_ids, wanted)).tolist()
                for d, ids in f.documents(places):
                    rows.append((name, int(f.doc_ids[d]) if f.known[d] else None, int(f.starts[d]), int(f.lengths[d]), ids))
                    size += len(ids)
                    if size >= slab:
                        yield _batch(rows, kinds, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, kinds, names)

    return run


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read(spark: SparkSession, folder: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (bytes) of all documents, or of those with one of ``doc_ids``.

    Asked for some, only the files whose range holds one are opened, and only the frames these documents lie in are decompressed.
    """
    try:
        files = spark.read.schema(_FILES).parquet(f"{folder}/files")
    except AnalysisException:
        raise ValueError(f"no token files in {folder}") from None
    names = None
    if doc_ids is not None:
        asked = F.array(*[F.lit(int(d)) for d in sorted(set(doc_ids))]).cast("array<long>")
        held = F.exists(asked, lambda d: (d >= F.col("first_doc")) & (d <= F.col("last_doc")))
        names = [r.file for r in files.where(held).select("file").collect()]
    if files.isEmpty() or names == []:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    found = _contents(spark, folder, names).mapInArrow(
        _documents(doc_ids), "file string, doc_id long, _within long, n_tokens long, ids binary")
    return found.join(files.select("file", "start"), "file").select(
        "doc_id", (F.col("start") + F.col("_within")).alias("start"), "n_tokens", "ids")


def opened(spark: SparkSession, file: str) -> TokenFile:
    """One file through Spark's file system, by ranges: for single documents on the driver."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(file)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())

    def fetch(offset: int, n: int) -> bytes:
        stream = system.open(at)
        try:
            stream.seek(offset)
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    return TokenFile(system.getFileStatus(at).getLen(), fetch)
