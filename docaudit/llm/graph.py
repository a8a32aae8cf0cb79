"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.storage import blocks, discard, join_apart, materialize

#: Edges or nodes in a task and a file of the loop below.
ROWS_PER_TASK = 1 << 16


def _kept(df: DataFrame, name: str, rows: int) -> DataFrame:
    """df, of about that many rows, written by as many tasks as these are worth; the rounds read and shuffle small tables, and a task for
    each shuffle partition would cost more than they do."""
    return materialize(df.coalesce(blocks(rows, ROWS_PER_TASK)), name, clean=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of the edges (u, v), which are longs: label is the least node of its component.

    Both stars are a partial minimum and an equi-join, so a node with very many neighbours is split by the engine; the number
    of rounds grows with the logarithm of a component's size. Edges stay in tables; only a count and whether a node is open come back.
    Edges of a node with itself or twice count once, null ends give no label, and no edges give no rows.
    """
    down = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(down.distinct(), "edges", clean=True)
    while rows := now.count():
        up = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        nodes = now.select("u", "v").unionByName(up).groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        # all edges are stars around their least nodes once no node with a smaller neighbour has a second one
        nodes = _kept(nodes.select("u", F.least("u", "m").alias("m"), ((F.col("m") < F.col("u")) & (F.col("n") > 1)).alias("open")), "nodes", 2 * rows)
        if nodes.filter("open").isEmpty():
            discard(nodes)
            break
        # large star: each node's greater neighbours, linked to the least of it and its neighbours
        large = _kept(join_apart(up, nodes.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large", rows)
        discard(nodes)
        discard(now)
        # small star: each node's smaller neighbours and itself, linked to the least of them; the row of the least stands for the node
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(blocks(rows, ROWS_PER_TASK))
        small = join_apart(large, least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = _kept(small.coalesce(blocks(rows, ROWS_PER_TASK)).distinct(), "edges", rows)
        discard(large)
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return _kept(labels.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), "labels", 2 * rows)


def as_edges(labels: DataFrame) -> DataFrame:
    """Labels of components as edges, for a search that goes on from them."""
    return labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
