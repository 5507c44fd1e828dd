"""Benchmark decontamination: windows of test words, held as a broadcast hash set, are looked for in training texts.

Texts and items are lower-cased (A-Z) and cut into words. Every run of ``WINDOW`` consecutive words of an item is a
window; an item of fewer words, but not none, is one window. The windows' hashes are sorted arrays with a bit map before
them; what passes the map and the arrays is verified byte for byte, so a result never rests on a hash.

The set is broadcast in blocks of at most ``BLOCK_BYTES`` of item text: the size of the benchmark is read first, and each
further block is one more narrow pass over the texts that carries the spans found so far. Nothing is shuffled.

Edge cases: null text has no words; a null item has no windows; an item without id marks words but is not listed;
repeated rows each get their own result; empty tables give no rows or no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from folderloom.llm.text import ALNUM, LOWER, pack, run_hashes, slabs, unpack, word_hashes, word_spans

WINDOW = 10
#: Item text in one broadcast: some five bytes of arrays come on each byte of text.
BLOCK_BYTES = 4 << 20

SCHEMA = "n_words long, n_hit long, items array<string>, hits array<struct<first:int,last:int>>"


class Windows:
    """The windows of one block of items, grouped by their number of words."""

    def __init__(self, items: list[Row], window: int = WINDOW):
        texts, found = [], {}
        self.ids, at = [], 0
        for item in items:
            data = LOWER[np.frombuffer((item[1] or "").encode(), np.uint8)]
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
            if not len(starts):
                continue
            raw = data.tobytes()
            words = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
            normal = b" ".join(words)
            size = min(window, len(words))
            begins = at + np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
            runs = run_hashes(word_hashes(data, starts, ends), size)
            n = len(runs)
            found.setdefault(size, []).append((runs, begins[:n], begins[size:size + n] - 1, np.full(n, len(self.ids))))
            self.ids.append(None if item[0] is None else str(item[0]))
            texts.append(normal + b" ")
            at += len(normal) + 1
        self.text, self.by_size = b"".join(texts), {}
        for size, parts in found.items():
            runs, first, last, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(runs, kind="stable")
            bits = max(16, int(8 * len(runs)).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[runs >> np.uint64(64 - bits)] = True
            self.by_size[size] = (runs[order], first[order], last[order], item[order], seen, np.uint64(64 - bits))

    def find(self, words: np.ndarray, rows: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray):
        """(first word, number of words, items) of each verified occurrence."""
        for size, (runs, first, last, item, seen, shift) in self.by_size.items():
            h = run_hashes(words, size)
            if not len(h):
                continue
            at = np.flatnonzero(seen[h >> shift])
            at = at[rows[at] == rows[at + size - 1]]
            low, high = np.searchsorted(runs, h[at], "left"), np.searchsorted(runs, h[at], "right")
            for i, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                found = b" ".join([raw[s:e] for s, e in zip(starts[i:i + size].tolist(), ends[i:i + size].tolist(), strict=True)])
                items = {int(item[k]) for k in range(a, b) if self.text[first[k]:last[k]] == found}
                if items:
                    yield i, size, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _scan(windows, keep: list[str], text: str):
    """A pass over Arrow batches with one block of windows; spans are [first word, end word)."""

    def run(batches):
        block: Windows = windows.value
        for batch in batches:
            n = batch.num_rows
            before = batch.column("hits").to_pylist() if "hits" in batch.schema.names else [None] * n
            listed = batch.column("items").to_pylist() if "items" in batch.schema.names else [None] * n
            n_words, spans, items = np.zeros(n, np.int64), {}, {}
            for i, j, data, offsets in slabs(batch.column(text)):
                data = LOWER[data]
                starts, ends, rows = word_spans(data, offsets, ALNUM)
                if not len(starts):
                    continue
                count = np.bincount(rows, minlength=j - i)
                n_words[i:j] = count
                base = np.concatenate([[0], np.cumsum(count)])
                for k, size, found in block.find(word_hashes(data, starts, ends), rows, data.tobytes(), starts, ends):
                    r = int(rows[k])
                    spans.setdefault(i + r, []).append((k - int(base[r]), k - int(base[r]) + size))
                    items.setdefault(i + r, set()).update(block.ids[x] for x in found)
            for r in range(n):
                if before[r]:
                    spans.setdefault(r, []).extend((x["first"], x["last"]) for x in before[r])
                if listed[r]:
                    items.setdefault(r, set()).update(listed[r])
            spans = {r: _merged(x) for r, x in spans.items()}
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), batch.column(text), pa.array(n_words),
                 pa.array([sum(b - a for a, b in spans.get(r, ())) for r in range(n)], pa.int64()),
                 pa.array([sorted(x for x in items.get(r, ()) if x is not None) for r in range(n)], pa.list_(pa.string())),
                 pa.array([[{"first": a, "last": b} for a, b in spans.get(r, ())] for r in range(n)],
                          pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                names=[*keep, text, "n_words", "n_hit", "items", "hits"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``keep`` and the text, with n_words, n_hit, items (sorted ids) and hits (merged word spans)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("_id"), F.col(item_text).alias("_text")).where(F.col("_text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    parts = -(-size // block_bytes) or 1
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    head = ", ".join(f"`{c}` {types[c]}" for c in [*keep, text])
    out = docs.select(*keep, text)
    for part in range(parts):
        block = items if parts == 1 else items.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(parts)) == part)
        windows = spark.sparkContext.broadcast(Windows(block.collect(), window))
        out = out.mapInArrow(_scan(windows, keep, text), f"{head}, {SCHEMA}")
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: how many words lie in windows of the benchmark, and the items they come from."""
    found = scan(docs, benchmark, [doc_id], text, **options)
    return found.select(
        doc_id, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _cut(text: str, hits) -> str:
    raw = text.encode()
    data = LOWER[np.frombuffer(raw, np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    out, at = [], 0
    for h in hits:
        out.append(raw[at:starts[h["first"]]])
        at = int(ends[h["last"] - 1])
    return b"".join([*out, raw[at:]]).decode()


def _cut_spans(batches):
    for batch in batches:
        texts, hits = batch.column("_text").to_pylist(), batch.column("hits").to_pylist()
        texts = [_cut(t, h) if h else t for t, h in zip(texts, hits, strict=True)]
        names = [c for c in batch.schema.names if c not in ("_text", "hits")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "_text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words cut out of their texts.

    The columns stay as they are, whatever their names: they travel in one struct beside the text.
    """
    packed = pack(docs, text)
    found = scan(packed, benchmark, ["_row"], "_text", **options)
    if remove == "documents":
        return unpack(found.where(F.col("n_hit") == 0), docs, text)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    kind = packed.schema["_row"].dataType.simpleString()
    return unpack(found.select("_row", "_text", "hits").mapInArrow(_cut_spans, f"_row {kind}, _text string"), docs, text)
