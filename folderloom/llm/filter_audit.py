"""How five filters interact, in every order they can be applied, by incremental retraction streaming.

A document fails A with under 50 words, B with 100 * distinct words < 65 * words, C with 100 * ``[A-Z]`` > 5 * code points, D
with any of ``#$%&*|``, and E if its text is identical to that of a smaller doc_id anywhere in the table.

The table is a stream of files, taken in available-now micro-batches:

1. Narrow map: a text becomes its 128-bit digest and the mask of A to D; texts go no further. Labels are joined to these rows.
2. Map-side combine: a task counts its rows by (part, mask, labels), and passes on, for each digest, only the rows of its
   smallest doc_id. Rows of a larger id fail E whatever comes, so a hot text leaves one row per Arrow batch.
3. Keyed text state: digests are dealt to buckets, and the state of a bucket holds, for each digest, the smallest id so far with
   the masks counted under it. An id that is new, or smaller than the one held, adds its masks to those that pass E; the masks
   held until then are retracted. What a batch changes goes to the part counters as signed rows, so they are always the sums.
4. The counters (part, mask, labels) of the stream's sink are summed and weighted by the 120 orders: at most 128 rows a part
   meet the 600 fixed rows of their mask, so no document is read again.

The stream's checkpoint and sink lie in the shared folder: a lost executor or a restarted driver goes on with the last batch, and
the sink takes each batch once. The state of ``buckets`` is rewritten where touched, once per micro-batch, so the files are dealt
into a few of them (``rounds``); buckets grow in number with the input, so that each stays small. On a large cluster set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.

Edge cases: null text counts as the empty text, null source as the part "" (as does ""); a row without doc_id counts as
having the largest id 2^63 - 1 and no labels; rows that share the smallest id of a text all pass E; a document with several
label rows has quality or toxic 1 if any of them has; null labels are not 1; repeated rows count each; a table without rows
gives no rows; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from folderloom.llm.text import flat
from folderloom.plans.staging import Stage

LETTERS = "ABCDE"
ROUNDS = 4
#: Bytes of input for each bucket of the state.
BUCKET_BYTES = 1 << 20
LARGEST = (1 << 63) - 1
LONG = 1 << 22

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
_LATER = bytes(range(0x80, 0xC0))  # bytes of a character behind its first
_GOOD, _TOXIC, _SAME = 32, 64, 16


def words(data: bytes) -> tuple[int, int]:
    """(words, distinct words), by pieces for very long texts."""
    if len(data) <= LONG:
        found = data.split()
        return len(found), len(set(found))
    n, seen, at = 0, set(), 0
    while at < len(data):
        cut = _SPACE.search(data, at + LONG)
        found = data[at:cut.start() if cut else len(data)].split()
        n, at = n + len(found), cut.end() if cut else len(data)
        seen.update(found)
    return n, len(seen)


def mask(data: bytes) -> int:
    """Bits 1, 2, 4, 8: the text fails A, B, C, D."""
    n, distinct = words(data)
    capitals, points = len(data) - len(data.translate(None, _CAPITALS)), len(data.translate(None, _LATER))
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | (_MARKS.search(data) is not None) << 3


def _masks(batches):
    for batch in batches:
        data, offsets = flat(batch.column("_text"))
        keys, masks = [], np.zeros(batch.num_rows, np.int32)
        for i in range(batch.num_rows):
            text = data[offsets[i]:offsets[i + 1]].tobytes()
            keys.append(hashlib.blake2b(text, digest_size=16).digest())
            masks[i] = mask(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(keys, pa.binary()), pa.array(masks)], names=["doc_id", "part", "key", "code"])


_MEMBER = ["key", "id", "part", "code"]


def _summed(frame: pd.DataFrame, by: list[str], column: str = "n") -> pd.DataFrame:
    return frame.groupby(by, sort=False, as_index=False)[column].sum()


def _smallest(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of the smallest id of each digest, equal ones counted together."""
    return _summed(frame[frame["id"] == frame.groupby("key")["id"].transform("min")], _MEMBER)


def _combine(buckets: int):
    """Counts of all rows of a batch (key null), and the rows of the smallest id of each digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                frame = frame.assign(n=1)
                held = _smallest(frame)
                held["bucket"] = [int.from_bytes(k[:7], "big") % buckets for k in held["key"]]
                every = _summed(frame, ["part", "code"]).assign(key=None, id=0)
                every["bucket"] = [zlib.crc32(f"{p}\0{c}".encode()) % buckets for p, c in zip(every["part"], every["code"])]
                yield pd.concat([held, every])[["bucket", *_MEMBER, "n"]]

    return run


_STATE = pa.schema([("key", pa.binary()), ("id", pa.int64()), ("part", pa.string()), ("code", pa.int32()), ("n", pa.int64())])


def _pack(frame: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STATE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.Table.from_pandas(frame[_STATE.names], schema=_STATE, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_all().to_pandas()


def _update(_bucket, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Signed changes (part, code, total, passing) of a micro-batch; the state keeps the smallest id of each digest."""
    counts, new = [], None
    for frame in frames:
        counts.append(frame[frame["key"].isna()])
        some = frame[frame["key"].notna()]
        new = _smallest(some if new is None else pd.concat([new, some]))
    moves = [_summed(pd.concat(counts), ["part", "code"]).rename(columns={"n": "total"}).assign(passing=0)]
    if len(new):
        old = _unpack(bytes(state.get[0])) if state.exists else None
        both = new if old is None else pd.concat([old.assign(was=1), new.assign(was=0)])
        if old is not None:
            least = both.groupby("key")["id"].transform("min")
            retracted = both[(both["was"] == 1) & (both["id"] > least)]
            new = both[(both["was"] == 0) & (both["id"] == least)]
            moves.append(_summed(retracted, ["part", "code"]).rename(columns={"n": "passing"}).assign(total=0).eval("passing = -passing"))
        moves.append(_summed(new, ["part", "code"]).rename(columns={"n": "passing"}).assign(total=0))
        state.update((_pack(_smallest(both)),))
    out = pd.concat(moves).groupby(["part", "code"], sort=False, as_index=False)[["total", "passing"]].sum()
    out = out[(out["total"] != 0) | (out["passing"] != 0)]
    if len(out):
        yield out[["part", "code", "total", "passing"]]


def _labelled(labels: DataFrame) -> DataFrame:
    one = lambda c: F.max((F.col(c) == 1) & F.col(c).isNotNull()).cast("int")
    named = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return named.agg(one("quality").alias("_good"), one("toxic").alias("_toxic"))


def counters(documents: DataFrame, labels: DataFrame, stage: Stage, buckets: int, doc_id: str = "doc_id", text: str = "text",
             source: str = "source") -> DataFrame:
    """Run the stream to its end; gives (part, code, total, passing), to be summed: code holds the mask of A to D and labels."""
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("part"),
                            F.col(f"`{text}`").alias("_text"))
    masked = rows.mapInArrow(_masks, "doc_id long, part string, key binary, code int")
    code = F.col("code") + _GOOD * F.coalesce("_good", F.lit(0)) + _TOXIC * F.coalesce("_toxic", F.lit(0))
    found = masked.join(_labelled(labels), "doc_id", "left").select(
        "key", F.coalesce("doc_id", F.lit(LARGEST)).alias("id"), "part", code.alias("code"))
    combined = found.mapInPandas(_combine(buckets), "bucket int, key binary, id long, part string, code int, n long")
    moves = combined.groupBy("bucket").applyInPandasWithState(
        _update, "part string, code int, total long, passing long", "texts binary", "append", GroupStateTimeout.NoTimeout)
    folder = f"{stage.root}/counters"
    moves.writeStream.format("parquet").outputMode("append").option("path", folder).option(
        "checkpointLocation", f"{stage.root}/state").trigger(availableNow=True).start().awaitTermination()
    schema = "part string, code int, total long, passing long"
    try:
        return documents.sparkSession.read.schema(schema).parquet(folder)
    except AnalysisException:  # no file has come
        return documents.sparkSession.createDataFrame([], schema)


def _orders(spark: SparkSession) -> DataFrame:
    """The 120 orders by 5 steps for each mask: the bit of the step's filter, and the bits of the filters before it."""
    bit = {c: 1 << i for i, c in enumerate(LETTERS)}
    steps = spark.createDataFrame(
        [("".join(o), s + 1, bit[c], sum(bit[b] for b in o[:s])) for o in itertools.permutations(LETTERS) for s, c in enumerate(o)],
        "filter_order string, step int, bit int, before int")
    return steps.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(LETTERS)) - 1))))


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from summed or unsummed counters."""
    spark = counts.sparkSession
    summed = counts.groupBy("part", "code").agg(F.sum("total").alias("total"), F.sum("passing").alias("passing"))
    # Those that pass E, and those that fail it as well; both rows stand even if one is empty, so no part is lost.
    both = summed.select("part", "code", F.explode(F.array(
        F.struct(F.lit(0).alias("same"), F.col("passing").alias("n")),
        F.struct(F.lit(_SAME).alias("same"), (F.col("total") - F.col("passing")).alias("n")))).alias("e"))
    n, flag = F.col("e.n"), lambda b: F.sum(F.when(F.col("code").bitwiseAND(b) != 0, F.col("e.n")).otherwise(0))
    masks = both.groupBy("part", (F.col("code").bitwiseAND(15) + F.col("e.same")).alias("mask")).agg(
        F.sum(n).alias("n"), flag(_GOOD).alias("good"), flag(_TOXIC).alias("toxic"))
    met = masks.join(F.broadcast(_orders(spark)), "mask")  # a fixed table of 600 rows for each of the 32 masks
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    add = lambda when, value="n": F.sum(F.when(when, F.col(value)).otherwise(0))
    # In the 120 orders each failed filter comes first among a document's failed ones equally often.
    share = F.floor(F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")
    return met.groupBy("part", "filter_order", "step").agg(
        add(~fails & ~earlier).alias("kept"), add(fails & ~earlier).alias("removed"), add(fails & earlier).alias("redundant"),
        add(F.col("mask") == F.col("bit")).alias("unique_fails"), add(fails & ~earlier, "good").alias("good_lost"),
        add(fails & ~earlier, "toxic").alias("toxic_lost"), F.sum(F.when(fails, F.col("n") * share).otherwise(0)).alias("shapley"))


def audit(spark: SparkSession, path: str, labels: DataFrame, rounds: int = ROUNDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The report of the Parquet table at ``path``, a file or a folder of files, streamed in about ``rounds`` micro-batches."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    # A pattern, as a stream takes no single file by its plain name.
    named = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // rounds))).parquet(named)
    return interactions(counters(stream, labels, Stage(spark), int(max(64, size // bucket_bytes))))
