"""Connected components of links, in rounds of least labels and pointer jumps; every round is a table in the shared folder."""
from pyspark.sql import DataFrame, functions as F

from tocsin.llm.shared import keep


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Returns node, label (the least node reachable) for every node of a link. No links, no rows."""
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-links")
    labels = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "graph-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_far"))
        step = keep(met.join(jump, "_new").select("node", "_old", F.least("_new", "_far").alias("label")), "graph-labels")
        labels = step.select("node", "label")
        if step.filter(F.col("_old") != F.col("label")).isEmpty():
            return labels


def widened(labels: DataFrame, links: DataFrame) -> DataFrame:
    """What components returns, for the links that gave labels and these together: only labels that these join are worked on."""
    if links.isEmpty():
        return labels
    own = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"_{x}"))
    ends = links.select("a", "b").join(own("a"), "a", "left").join(own("b"), "b", "left")
    of = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b"))
    every = labels.union(of.select("node", F.col("node").alias("label"))).distinct()  # a label is a node with itself as label
    new = every.join(of.select(F.col("node").alias("label"), F.col("label").alias("_new")), "label", "left")
    return keep(new.select("node", F.coalesce("_new", "label").alias("label")), "graph-labels")
