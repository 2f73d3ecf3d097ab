"""Connected components of links by smallest labels with pointer jumping, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, kept_lean as kept


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, comp): for every node of a link the smallest node it reaches.

    A round takes the least label around each node and then that label's own label, so paths shorten by half;
    it ends when nothing changes. Links of one node are summed before they are shuffled; the driver sees a count.
    """
    spark = links.sparkSession
    both = kept(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "cc-links")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "cc-labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_near"))
        near = labels.join(around, "node").select("node", F.least("comp", "_near").alias("_near"), F.col("comp").alias("_old"))
        jump = labels.select(F.col("node").alias("_near"), F.col("comp").alias("_far"))
        new = kept(near.join(jump, "_near", "left").select("node", F.least("_near", F.coalesce("_far", "_near")).alias("comp"), "_old"), "cc-labels")
        done = new.where("comp <> _old").isEmpty()
        dropped(spark, labels)
        labels = new.select("node", "comp")
        if done:
            dropped(spark, both)
            return labels
