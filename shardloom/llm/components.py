"""Connected components of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links`` (a, b): component is the smallest node reachable.

    Each round a node takes the least label among its neighbours, then its label's label; rounds end
    when no label changes. Rows that hold a null are ignored; so are repeated links and loops, but
    a node with loops alone is returned.
    """
    known = links.where("a IS NOT NULL AND b IS NOT NULL")
    both = staged(known.select("a", "b").union(known.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component"))
    labels = staged(labels, "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("above"))
        new = staged(stepped.join(up, F.col("component") == F.col("up")).select("node", "was", F.least("component", "above").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return labels
