"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.hot import spread_join
from tallyloom.llm.scratch import materialize


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has two columns of node ids; returns ``node`` and ``component``, the smallest node that it reaches.

    Only nodes with a link to another node are returned. Null ends and links of a node with itself link nothing;
    repeated links count once. An empty table gives an empty table.
    Every round groups by node with a map-side minimum and writes its edges to the shared folder; nodes with very many
    neighbours are split where minima go back to their edges.
    """
    a, b = links.columns[:2]
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "cc-edges")
    mark = _mark(edges)
    while mark[0]:
        # Large star: every larger neighbour of a node is linked to the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        large = spread_join(both, least.select("a", "m"), ["a"], ["b"], counts=least.select("a", "n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        edges = materialize(small, "cc-edges")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
