"""Connected components of a table of links, kept distributed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.plans.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; the component is its least node.

    Every round each node takes the least label of its neighbours and then its label's label, so that
    the rounds grow with the logarithm of a component's diameter. A hub's neighbours are reduced by
    partial aggregation; nothing but the number of changes reaches the driver.
    """
    both = cut(links.where("a <> b").select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        step = cut(step.join(jump, F.col("new") == F.col("via"), "left").select("node", "label", F.least("new", F.coalesce("further", "new")).alias("new")))
        if step.where("new <> label").limit(1).count() == 0:
            return step.select("node", F.col("new").alias("component"))
        labels = step.select("node", F.col("new").alias("label"))
