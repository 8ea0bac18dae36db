"""Connected components by label propagation with short cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edges, itself included.

    Each round every node takes the smallest label among its own and its neighbours', and then the
    label of that label, so that chains shrink by more than half. Labels live in tables; the driver
    sees a count a round.
    """
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).where("u <> v").distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "cc-labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("near"))
        low = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("_n"), F.col("component").alias("up"))
        step = stored(low.join(up, F.col("low") == F.col("_n"), "left").select("node", "was", F.least("low", F.coalesce("up", "low")).alias("component")), "cc-labels")
        labels = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return labels
