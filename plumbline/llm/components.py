"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialise, meet, remove_scratch, scratch_path


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (the least id reachable) of every id in ``links``.

    Each round, every vertex takes the least of its neighbours and itself, links are rewritten to what their ends took, and
    links within one vertex and repeated ones go. So the links shrink from round to round, and when none is left each
    component is one vertex, its least id, which always takes itself. Only minima and distinct links are shuffled,
    both reduced before the exchange; a hub is a skewed join that is split. Each round ends in the shared folder.
    """
    spark = links.sparkSession
    edges = materialise(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct(), "edges")
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id")))
    path = scratch_path(spark, "labels")
    ends.distinct().withColumn("component", F.col("id")).write.parquet(path)
    while True:
        labels = spark.read.parquet(path)
        if not edges.limit(1).count():
            return labels
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        took = materialise(near.groupBy(F.col("a").alias("from")).agg(F.least(F.first("a"), F.min("b")).alias("to")), "took")
        following = scratch_path(spark, "labels")
        meet(labels, took, labels["component"] == took["from"], "left").select("id", F.coalesce("to", "component").alias("component")).write.parquet(following)
        remove_scratch(spark, path)
        path = following
        one = meet(edges, took, edges["a"] == took["from"]).select(F.col("to").alias("x"), "b")
        two = meet(one, took, one["b"] == took["from"]).select("x", F.col("to").alias("y"))
        edges = materialise(two.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
