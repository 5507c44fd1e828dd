"""Connected components of a link table, by labels that spread and jump; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folderloom.plans.staging import Stage


def components(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is the smallest node of its component.

    Each round takes the least label among a node and its neighbours, lowers the label of the label just given up to the
    same value, and lets every node jump to its label's label; the number of rounds grows with the logarithm of the
    longest path. Rounds are staged, so a lost executor costs one round at most.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = stage.keep(both.union(links.select(F.col("b"), F.col("a"))).distinct(), f"{name}-both")
    labels = stage.keep(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        found = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # What a node learns, the node that was its label learns too.
        told = found.where(F.col("was") != F.col("label")).groupBy(F.col("was").alias("node")).agg(F.min("label").alias("told"))
        found = stage.keep(found.join(told, "node", "left").select(
            "node", "was", F.least("label", F.coalesce("told", "label")).alias("label")), f"{name}-{step}-near")
        top = found.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = stage.keep(found.join(top, "label").select("node", "was", F.col("top").alias("label")), f"{name}-{step}")
        if labels.where(F.col("was") != F.col("label")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
