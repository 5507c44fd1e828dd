"""MinHash near-duplicates by tensored banding, with every link verified on full shingle sets.

Each document has two small collections of minhash rows: ``ROWS`` rows a_i of ``WIDTH`` minhashes and as many rows b_j. Every
pair (a_i, b_j) is a table key, so 2 * ROWS * WIDTH minhashes make ROWS^2 tables of 2 * WIDTH minhashes each, about a
square root of what separate tables would cost. Two documents of similarity s share a key with probability
(1 - (1 - s^WIDTH)^ROWS)^2: 0.9996 at 0.8, and more above.

1. Equal sets are one class, named by its smallest doc_id; only classes go on, so exact copies make no pairs.
2. A key can join classes only if its a_i and its b_j each have two. Values that one class alone has are dropped before
   pairs are formed: nothing is lost, and most keys of a clean corpus are never made.
3. A class is in up to ROWS tables of each of its a_i. A value of an a_i whose members mostly share their b_j too, as those of a
   group of near copies do, would repeat them in all of these, so its classes stay one bucket where that is less work: each is
   in it once, and pairs that share the a_i alone are compared as well. The other values are split into their tables.
4. Buckets with the same members count once. First every bucket of the tables (a_i, b_i) compares its members with one
   hub, then every bucket that still has members of two components does so, ``HUBS`` times with another hub.
   So no group emits all its pairs unless none of them link. Between rounds a class is one row with its open keys.
5. Then all remaining pairs of different components meet in their buckets, the largest component of each bucket on one side
   only. A pair leaves the join only if it can link by its sizes and by its odd sketches: bit k of a sketch tells whether an odd
   number of members hash to k, so two sketches differ in at most as many bits as the sets differ in members. A pair with too
   many differing bits cannot link: the sketch never loses a link, and there is no cap.
6. What is left is verified on full sets.

Edge cases: null text, or one without words, has an empty set and links with nothing; fewer words than ``n`` make one
shingle; rows that share a doc_id count as one document with the links of all; a row without doc_id links with nothing and
has no component; ties cannot occur, as names are smallest ids; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folderloom.llm.components import components
from folderloom.llm.text import LOWER, NOT_SPACE, mix, run_hashes, slabs, word_hashes, word_spans
from folderloom.plans.staging import Stage

ROWS, WIDTH = 12, 3
#: Rounds of one hub in every open bucket. They only save work: the pairs that they leave are all compared after them.
HUBS = 3
#: Pairs that may be compared to save one row of a bucket, which is shuffled in every round.
ROW = 16
#: 64-bit words of an odd sketch.
WORDS = 16
PERCENT = 80
_SEED = 7


def _sets(column: pa.Array, n: int):
    """The sorted distinct shingle hashes of each text."""
    for i, j, data, offsets in slabs(column):
        data = LOWER[data]
        starts, ends, rows = word_spans(data, offsets, NOT_SPACE)
        hashes = word_hashes(data, starts, ends)
        bounds = np.searchsorted(rows, np.arange(j - i + 1))
        runs = run_hashes(hashes, n)
        for r in range(j - i):
            a, b = int(bounds[r]), int(bounds[r + 1])
            if b - a >= n:
                yield np.unique(runs[a:b - n + 1])
            else:
                yield run_hashes(hashes[a:b], b - a) if b > a else hashes[:0]


def _print(s: np.ndarray) -> bytes:
    """Two sums over the members: equal sets agree, others do with odds of 2^-128."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).tobytes()


def _sketch(n: int, rows: int, width: int):
    rng = np.random.default_rng(_SEED)
    factor = rng.integers(1, 1 << 62, 2 * rows * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, 2 * rows * width, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            sizes, prints, keys = [], [], []
            for s in _sets(batch.column("_text"), n):
                sizes.append(len(s))
                prints.append(_print(s))
                if not len(s):
                    keys.append(np.empty(0, np.int64))
                    continue
                least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(s), 4096):
                    h = s[at:at + 4096, None] * factor + shift
                    h ^= h >> np.uint64(29)
                    h *= np.uint64(0xBF58476D1CE4E5B9)
                    np.minimum(least, h.min(axis=0), out=least)
                parts = least.reshape(2 * rows, width)
                key = np.arange(2 * rows, dtype=np.uint64)
                for w in range(width):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, w])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["_id", "n", "print", "keys"])

    return run


def _odd(s: np.ndarray) -> np.ndarray:
    """One bit for each of ``64 * WORDS`` hash values: is the number of members with that value odd?"""
    odd = np.bincount((s % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _full(n: int):
    def run(batches):
        for batch in batches:
            sets = list(_sets(batch.column("_text"), n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([_print(s) for s in sets], pa.binary()),
                 pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                 pa.array([_odd(s) for s in sets], pa.list_(pa.int64()))], names=["_id", "print", "shingles", "odd"])

    return run


def _close(percent: int):
    """Whether ``class`` and ``other`` of one bucket can link, by what both rows hold: sizes n, _n and sketches odd, _odd."""
    apart = sum((F.bit_count(F.col("odd")[k].bitwiseXOR(F.col("_odd")[k])) for k in range(WORDS)), F.lit(0))
    # Sets of sizes n and m that differ in d members link if (100 + percent) * d <= (100 - percent) * (n + m).
    return _sized(percent) & (apart * (100 + percent) <= (F.col("n") + F.col("_n")) * (100 - percent))


def _sized(percent: int):
    return 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link; each side's set is joined to the pair, and hot hubs are split by adaptive joins."""
    some = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("_left")).hint("merge"), "a")
    some = some.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("_right")).hint("merge"), "b")
    both = F.size(F.array_intersect("_left", "_right")).cast("long")
    # 100 * both >= percent * (left + right - both)
    return some.where(both * (100 + percent) >= percent * (F.size("_left") + F.size("_right"))).select("a", "b")


def _placed(left: DataFrame, rows: int, stage: Stage) -> DataFrame:
    """(key, class, n, first, later, _n): the members of each bucket of two or more, of those with the same members one.

    A value of an a_i is one bucket, or split into tables by the values of its members' b_j, whichever is less work. Its
    table (a_i, b_i) is a bucket in either case; ``first`` marks these, ``later`` those in which all pairs meet in the end.
    """
    same = F.sum(F.shiftright(F.xxhash64(F.lit("sum"), "class"), 16)).alias("_sum"), F.min("class").alias("_least")
    whole = left.select("class", "n", F.explode("a").alias("_a"), "b").select("class", "n", "_a.at", "_a.value", "b")
    cut = F.transform("b", lambda b: F.struct(F.xxhash64("value", b["value"]).alias("key"), (F.col("at") + rows == b["at"]).alias("first")))
    parts = whole.select("class", "value", F.inline(cut)).groupBy("value", "key").agg(
        F.count("*").alias("_n"), *same, F.bool_or("first").alias("first")).where("_n > 1")
    parts = stage.keep(parts, "parts")
    # A value whose members share no b_j has no part, and no work.
    work = parts.groupBy("value").agg(F.sum(F.col("_n") * (F.col("_n") + ROW)).alias("_work"))
    values = whole.groupBy("value").agg(F.count("*").alias("_n"), *same).join(work.hint("merge"), "value")
    values = stage.keep(values.withColumn("split", F.col("_work") < F.col("_n") * (F.col("_n") + ROW)), "values")
    key = F.xxhash64("value").alias("key")
    buckets = parts.join(values.select("value", "split").hint("merge"), "value").where("split OR first")
    buckets = buckets.withColumnRenamed("split", "later").drop("value").unionByName(
        values.where("NOT split").select(key, "_n", "_sum", "_least", F.lit(False).alias("first"), F.lit(True).alias("later")))
    buckets = buckets.groupBy("_n", "_sum", "_least").agg(
        F.min("key").alias("key"), F.bool_or("first").alias("first"), F.bool_or("later").alias("later"))
    members = whole.join(values.select("value", "split").hint("merge"), "value")
    keys = F.when(F.col("split"), cut["key"]).otherwise(F.concat(F.filter(cut, lambda c: c["first"])["key"], F.array(key)))
    members = members.select("class", "n", F.explode(keys).alias("key"))
    return members.join(buckets.select("key", "first", "later", "_n").hint("merge"), "key")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = PERCENT,
                    rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (is it that one)."""
    stage = Stage(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    sketched = stage.keep(texts.mapInArrow(
        _sketch(n, rows, width), f"_id {kind}, n long, print binary, keys array<long>"), "sketched")
    named = sketched.where((F.col("n") > 0) & F.col("_id").isNotNull())
    classes = named.groupBy("print").agg(F.min("_id").alias("owner"), F.max("n").alias("n"), F.any_value("keys").alias("keys"))
    classes = stage.keep(classes.withColumn("class", F.col("owner")), "classes")
    one_id_many_texts = not classes.groupBy("owner").count().where("count > 1").isEmpty()
    if one_id_many_texts:  # classes get names of their own, and ids are linked in the end
        classes = classes.withColumn("class", F.xxhash64("print"))
    live = stage.keep(classes.select("class", "n", F.posexplode("keys").alias("at", "value")), "rows")
    shared = live.groupBy("value").agg(F.count("*").alias("_n")).where("_n > 1").select("value")
    value = F.struct("at", "value")
    left = live.join(shared.hint("merge"), "value").groupBy("class", "n").agg(
        F.collect_list(F.when(F.col("at") < rows, value)).alias("a"), F.collect_list(F.when(F.col("at") >= rows, value)).alias("b"))
    left = stage.keep(left.where((F.size("a") > 0) & (F.size("b") > 0)), "left")
    active = stage.keep(_placed(left, rows, stage), "active-0")
    # Full sets are made again from the texts, for the classes that have a candidate only.
    wanted = classes.select("class", "owner", "print", "n").join(active.select("class").distinct().hint("merge"), "class", "left_semi")
    wanted = stage.keep(wanted, "wanted")
    again = texts.join(wanted.select(F.col("owner").alias("_id")).distinct().hint("merge"), "_id", "left_semi")
    again = again.mapInArrow(_full(n), f"_id {kind}, print binary, shingles array<long>, odd array<long>").alias("s").join(
        wanted.hint("merge").alias("w"), (F.col("s._id") == F.col("w.owner")) & (F.col("s.print") == F.col("w.print")))
    sets = stage.keep(again.select("class", F.col("w.n").alias("n"), "shingles", "odd").dropDuplicates(["class"]), "sets")
    # From here on a class is one row with its keys, so that labels and sketches are fetched once per class, not once per bucket.
    held = F.collect_list(F.struct("key", "first", "later")).alias("keys")
    nodes = active.groupBy("class", "n").agg(held, F.sum("_n").alias("weight")).join(sets.select("class", "odd").hint("merge"), "class")
    nodes = stage.keep(nodes.withColumn("comp", F.col("class")), "nodes-0")
    links, labels = None, None
    for turn in range(HUBS + 2):
        placed = nodes.select("class", "n", "comp", "weight", *["odd"] * (turn > 0), F.inline("keys"))
        # At first the diagonal tables alone: most of a group joins there, and the other buckets meet what is left of it.
        placed = placed.where("later" if turn else "first")
        # A bucket is open while it has members of two components.
        # The hub is the member that shares most buckets with others, as the middle of a group does; later ones are drawn by that.
        drawn = F.xxhash64(F.lit(turn), "class")
        race = -F.log((F.shiftrightunsigned(drawn, 11) + 1) / float(1 << 53)) / F.pow("weight", F.lit(2.0))
        place = F.struct((race if turn else -F.col("weight").cast("double")).alias("race"), drawn.alias("drawn"))
        parts = placed.groupBy("key", "comp").agg(F.count("*").alias("_c"), F.min(place).alias("_p"))
        open_ = parts.groupBy("key").agg(F.count("*").alias("_parts"), F.max_by("comp", "_c").alias("main"), F.min("_p").alias("_hub"))
        open_ = open_.where("_parts > 1").select("key", "main", "_hub")
        active = stage.keep(placed.join(open_.hint("merge"), "key"), f"open-{turn}")
        if turn and active.isEmpty():
            break
        if turn > HUBS:
            hub, own = active, active.where(F.col("comp") != F.col("main"))
        else:
            hub, own = active.where(place == F.col("_hub")), active
        hub = hub.select("key", F.col("class").alias("other"), F.col("n").alias("_n"), F.col("comp").alias("_comp"),
                         *[F.col("odd").alias("_odd")] * (turn > 0))
        pairs = own.join(hub.hint("merge"), "key").where((F.col("comp") != F.col("_comp")) & (_close(percent) if turn else _sized(percent)))
        if turn > HUBS:  # two members outside the largest component meet once
            pairs = pairs.where((F.col("_comp") == F.col("main")) | (F.col("class") < F.col("other")))
        pairs = pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
        found = stage.keep(_verified(pairs, sets, percent), f"found-{turn}")
        if turn:  # only keys of open buckets go on, and the classes that have one
            nodes = nodes.drop("keys").join(active.groupBy("class").agg(held).hint("merge"), "class")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links, stage, f"comp-{turn}")
            joined = labels.select(F.col("node").alias("class"), "label")
            nodes = nodes.join(joined.hint("merge"), "class", "left").withColumn("comp", F.coalesce("label", "comp")).drop("label")
        nodes = stage.keep(nodes, f"nodes-{turn + 1}")
    if one_id_many_texts:
        ids = named.select("_id", "print").distinct().select("_id", F.xxhash64("print").alias("class"))
        graph = ids.select(F.xxhash64(F.lit("id"), "_id").alias("a"), F.col("class").alias("b"))
        graph = graph if links is None else graph.union(links)
        labels = components(graph, stage, "ids")
        label = ids.select("_id", F.xxhash64(F.lit("id"), "_id").alias("node")).distinct().join(labels, "node")
        label = label.select("_id", F.min("_id").over(_by("label")).alias("component_id"))
    else:
        label = named.select("_id", "print").join(classes.select("print", "class"), "print")
        if labels is not None:
            label = label.join(labels.select(F.col("node").alias("class"), "label").hint("merge"), "class", "left")
            label = label.select("_id", F.coalesce("label", "class").alias("component_id"))
        else:
            label = label.select("_id", F.col("class").alias("component_id"))
    out = sketched.select("_id", "n").join(label.distinct().hint("merge"), "_id", "left")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("_id").isNull() | (component == F.col("_id"))).alias("kept"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)
