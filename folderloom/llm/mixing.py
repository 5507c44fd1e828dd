"""Mixing sources to target weights by subset sums over document lengths.

Sizes are words. Sources in order of code point, null last, weigh 1, 2, 3, repeating, and share all words of the corpus; a
target stops at ``MOST`` times its source's size and the excess goes to the others by weight. A target of r times the
source's size and a rest takes every document r times. The rest is filled from the counts of documents by exact length:
each length gives its proportional share, and the small remaining budget is met by a bounded-knapsack dynamic program over
the lengths still available. Documents of a length are then taken in seeded order until its count is reached.

What is moved: (document, source, length) rows are ranked within (source, length, slice), where a slice holds a 1024th of
the documents of a source and length, chosen by the seeded hash. A third of all rows with one source and one length thus
spreads over 1024 groups. The lengths of one source, at most as many as there are distinct lengths, meet in one task; its
documents never do. Nothing is collected but one row of totals in each round of resharing.

Edge cases: null text has size 0; documents of size 0 are in the result with taken 0; null is a source of its own; repeated
rows are documents of their own; ties of the seeded hash go by doc_id; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folderloom.plans.staging import Stage

MOST = 3
SLICES = 1024
#: The dynamic program's budget, in longest documents of the source: enough that nearly every sum can be met.
REACH = 4


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, stage: Stage, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with the target of each.

    A target is min(most * size, level * weight); the level rises from round to round as sources reach their stop, and
    each round is one aggregate over the sources.
    """
    spark = sources.sparkSession
    ordered = sources.select("source", "source_size").orderBy(F.col("source").asc_nulls_last())
    ranked = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    kind = sources.schema["source"].dataType.simpleString()
    ranked = spark.createDataFrame(ranked, f"source {kind}, source_size long, rank long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stage.keep(ranked.withColumn("weight", weight), "ranked")
    stop, level = F.col("source_size") * float(most), None
    while True:
        full = F.lit(False) if level is None else stop <= F.lit(level) * F.col("weight")
        total, used, left = ranked.agg(
            F.sum("source_size"), F.sum(F.when(full, stop)), F.sum(F.when(~full, F.col("weight")))).first()
        if not left:
            break
        new = (float(total) - (used or 0.0)) / left
        if level is not None and new <= level:
            break
        level = new
    level = 0.0 if level is None else level
    return ranked.select("source", "source_size", F.least(stop, F.lit(level) * F.col("weight")).alias("target"))


def subset(lengths: np.ndarray, counts: np.ndarray, budget: int, reach: int = REACH) -> np.ndarray:
    """How many documents of each length to take, so that their sum comes as near below ``budget`` as can be found.

    Proportional shares first, then a dynamic program on the rest: binary parts of what each length has left, and for each
    sum the part that first reached it, which is enough to walk back from the best sum.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    share = budget / total
    taken = np.minimum(np.floor(counts * share).astype(np.int64), counts)
    rest = budget - int((lengths * taken).sum())
    wanted = reach * int(lengths.max())
    for i in np.argsort(-(counts * share - taken), kind="stable"):
        if rest - lengths[i] >= wanted and taken[i] < counts[i]:
            taken[i] += 1
            rest -= int(lengths[i])
    if rest > wanted:  # the shares were cut short by counts: fill up by longest lengths
        for i in np.argsort(-lengths, kind="stable"):
            k = min(int(counts[i] - taken[i]), (rest - wanted) // int(lengths[i]))
            if k > 0:
                taken[i] += k
                rest -= k * int(lengths[i])
    part_of = np.full(rest + 1, -1, np.int32)
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    parts: list[tuple[int, int]] = []
    for i in range(len(lengths)):
        left, k = int(min(counts[i] - taken[i], rest // lengths[i])), 1
        while left > 0 and not reached[rest]:
            k = min(k, left)
            step = k * int(lengths[i])
            if step <= rest:
                new = np.zeros(rest + 1, bool)
                new[step:] = reached[:-step]
                new &= ~reached
                part_of[new] = len(parts)
                parts.append((i, k))
                reached |= new
            left -= k
            k *= 2
        if reached[rest]:
            break
    s = int(np.flatnonzero(reached)[-1])
    while s > 0:
        i, k = parts[part_of[s]]
        taken[i] += k
        s -= k * int(lengths[i])
    return taken


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", kind="stable")
    target, total = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    rounds = int(target // total) if total else 0
    extra, some = np.zeros(len(pdf), np.int64), lengths > 0
    if some.any():
        extra[some] = subset(lengths[some], counts[some], round(target - rounds * total))
    return pd.DataFrame({"source": pdf["source"], "size": lengths, "source_size": total, "target": target,
                         "rounds": rounds, "extra": extra})


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), seed: int = 42, most: int = MOST, slices: int = SLICES) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes, repeats counted."""
    stage = Stage(docs.sparkSession)
    sized = docs.select(F.col(doc_id).alias("doc_id"), size_of(text).alias("size"), F.col(source).alias("source"))
    sized = stage.keep(sized, "sized")
    order = F.xxhash64(F.lit(seed), "doc_id")
    sized = sized.withColumn("order", order).withColumn("slice", F.pmod(F.shiftrightunsigned("order", 40), F.lit(slices)))
    keys = ["source", "size", "slice"]
    # Few slices are ranked only to find where the count of a length is reached: rows before each slice.
    counted = stage.keep(sized.groupBy(*keys).agg(F.count("*").alias("n")), "slices")
    before = counted.withColumn("before", F.sum("n").over(
        Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)))
    lengths = counted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    totals = stage.keep(lengths.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), "totals")
    aimed = targets(totals, stage, weights, most)
    kind = docs.schema[source].dataType.simpleString()
    plan = (
        lengths.alias("l").join(aimed.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source")))
        .select("l.source", "size", "n", "source_size", "target").groupBy("source")
        .applyInPandas(_plan, f"source {kind}, size long, source_size long, target double, rounds long, extra long"))
    plan = stage.keep(plan, "plan")
    # Merge joins: both sides grow with the data, however small they look when compressed.
    cuts = before.alias("b").join(plan.hint("merge").alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")) & (F.col("b.size") == F.col("p.size")))
    cuts = cuts.select("b.source", "b.size", "slice", F.coalesce("before", F.lit(0)).alias("before"), "source_size", "target", "rounds", "extra")
    placed = sized.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("order", "doc_id")))
    same = F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")) & (F.col("d.slice") == F.col("c.slice"))
    chosen = (F.col("before") + F.col("place") <= F.col("extra")).cast("long")
    return placed.alias("d").join(cuts.hint("merge").alias("c"), same).select(
        F.col("d.doc_id").alias(doc_id), F.col("d.size").alias("size"), "source_size", "target",
        (F.col("d.size") * (F.col("rounds") + chosen)).alias("taken"))
