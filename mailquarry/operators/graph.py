"""Social graphs: co-occurrence, degrees, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def social_graph(flat: DataFrame, nodes: DataFrame, least: int = 5) -> DataFrame:
    """(a, b, weight), a < b: messages on which two of the given nodes appear, if `least` at least. flat: (doc_id, contact).

    nodes is a bounded top list, so the pairs of a message are bounded too.
    """
    own = flat.join(F.broadcast(nodes.select("contact")), "contact").distinct()
    pairs = own.withColumnRenamed("contact", "a").join(own.withColumnRenamed("contact", "b"), "doc_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, coefficient): the share of its neighbours' pairs that are edges; 0 below degree 2.

    Each triangle is found once, from its edge between the two least nodes, over edges directed by order.
    """
    e = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()
    wedge = e.select("u", "v").join(e.select("u", F.col("v").alias("w")), "u").where("v < w")
    triangles = wedge.join(e.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    per_node = triangles.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    d = degrees(e.select(F.col("u").alias("a"), F.col("v").alias("b")))
    value = F.when(F.col("degree") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return d.join(per_node, "node", "left").select("node", F.round(value, 6).alias("coefficient"))
