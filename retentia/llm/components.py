"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); the component is its smallest node.

    Nodes with one label are one group. Each round every group takes the
    smallest label next to any of its nodes, and then the label which that
    group takes, so groups at least halve in number. Labels stay in Spark;
    the driver only learns whether any moved.
    """
    both = materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        nodes = labels.join(around, "u").select("u", "label", F.least("label", "near").alias("near"))
        best = nodes.groupBy("label").agg(F.min("near").alias("best"))
        moves = materialise(best, "moves")
        if not moves.filter("best < label").limit(1).count():
            discard(moves)
            discard(both)
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
        far = moves.select(F.col("label").alias("best"), F.col("best").alias("far"))
        jump = moves.join(far, "best", "left").select("label", F.coalesce("far", "best").alias("to"))
        new = materialise(labels.join(jump, "label").select("u", F.col("to").alias("label")), "labels")
        discard(moves)
        discard(labels)
        labels = new
