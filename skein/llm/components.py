"""Connected components of a link table by iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) longs. Gives (node, label): label is the smallest node reachable. Only nodes with links have rows.

    Each round every node takes the smallest label among its neighbours and then that label's own label, so paths
    shrink by doubling. Tables are written once a round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = save(both, "edges")
    labels = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        new = save(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("new"), "label"), "labels")
        changed = new.where("new <> label").limit(1).count()
        drop(labels)
        labels = new.select("node", F.col("new").alias("label"))
        labels._skein_path = new._skein_path
        if not changed:
            drop(both)
            return labels
