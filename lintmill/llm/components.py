"""Smallest reachable label of each node, over links that Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintmill.session import materialize


def least_labels(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, label): the smallest node that links reach.

    Every round takes the least label among the neighbours, the node itself and the
    node that its label names, so long chains take logarithmically many rounds. A round
    is one join and one minimum, as the driver keeps threads, plans and tables of
    small joins for every one. Each round is written to the shared folder; only
    whether labels changed reaches the driver.
    """
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = links.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), back)).alias("link"))  # links are worked out once
    both = materialize(both.select("link.*").distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                         .withColumnRenamed("a", "node"), "labels")
    while True:
        asked = both.union(labels.select("node", F.explode(F.array("node", "label"))))
        new = materialize(
            asked.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
            .agg(F.max(F.expr("if(a = b, label, null)")).alias("old"), F.min("label").alias("label")), "labels",
        )
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            return labels
