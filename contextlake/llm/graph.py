"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.llm import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (columns a, b): comp is the
    smallest node reachable.

    Each round hooks every node to its smallest neighbour, shortens the
    resulting trees to stars by pointer jumping, and contracts the edges; the
    edge table shrinks geometrically.  Minima are aggregated map-side first, and
    joins read written tables so that AQE can split a hub's rows.  Loops and
    null ends are ignored; no edges give an empty table.
    """
    edges = scratch.table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "hooks")
        while True:
            step = hooks.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            jumped = hooks.filter("node <> comp").join(step.filter("comp <> up"), "comp")
            if jumped.isEmpty():
                break
            hooks = scratch.table(hooks.join(step, "comp").select("node", F.col("up").alias("comp")), "hooks")
        to_a = hooks.select(F.col("node").alias("a"), F.col("comp").alias("x"))
        to_b = hooks.select(F.col("node").alias("b"), F.col("comp").alias("y"))
        edges = scratch.table(
            edges.join(to_a, "a").join(to_b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            labels = scratch.table(labels.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``components`` of the edges that gave ``labels`` and of further ``edges``.

    Only the further edges are gone through again, between components.
    """
    x = labels.select(F.col("node").alias("a"), F.col("comp").alias("x"))
    y = labels.select(F.col("node").alias("b"), F.col("comp").alias("y"))
    bridges = edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    found = components(bridges)
    up = found.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    known = labels.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
    return known.unionByName(found.join(labels.select("node"), "node", "left_anti"))
