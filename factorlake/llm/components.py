"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.llm.shared import mark, release, release_since, sorted_join, written


def connected(edges: DataFrame) -> DataFrame:
    """edges (a, b) to a written table (node, component): the least node reachable, for every node of an edge.

    In each round every node points to its least neighbour, pointers are followed to their roots, and the
    edges are redrawn between roots; the rest shrinks by more than half each round. All tables stay distributed.
    """
    before = mark()
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        roots = written(near.select("node", F.least("node", "m").alias("root"), F.lit(True).alias("moved")), "pointers")
        while not roots.where("moved").isEmpty():
            jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            after = written(roots.join(sorted_join(jump), "root").select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")), "pointers")
            release(roots)
            roots = after
        if labels is None:
            labels = written(roots.select("node", "root"), "labels")
        else:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            after = written(labels.join(sorted_join(step), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
            release(labels)
            labels = after
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(sorted_join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))), end)
        fewer = written(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b").distinct(), "edges")
        release(edges, roots)
        edges = fewer
    if labels is None:
        out = written(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
    else:
        out = written(labels.select("node", F.col("root").alias("component")), "components")
    release_since(before, out)
    return out
