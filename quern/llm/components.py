"""Connected components by contraction: nodes hook to their least neighbour, chains of hooks are cut short, edges are relabelled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, component (the least node it reaches) of every node with an edge; edges: a, b (long).

    The least node of a component never hooks to another, so it is what is left of it. Each round leaves only local
    minima; its labels are written to the shared folder. Neighbours are only ever aggregated to their least one, before they are
    shuffled. The joins of rows with their labels meet all rows of one label; both sides are written tables, so
    that Spark's skew join splits a label that very many rows have.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges0")
    rounds: list[DataFrame] = []
    while not rounds or not now.isEmpty():
        k = len(rounds)
        either = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hooks = scratch.keep(either.groupBy("u").agg(F.min("v").alias("l")).select("u", F.least("u", "l").alias("l")), f"{name}-hooks{k}")
        further = lambda x, y: x.join(y.select(F.col("u").alias("l"), F.col("l").alias("m")), "l").select("u", F.col("m").alias("l"))
        labels = scratch.keep(further(further(hooks, hooks), hooks), f"{name}-labels{k}")
        rounds.append(labels)
        to = lambda c: labels.select(F.col("u").alias(c), F.col("l").alias(f"l{c}"))
        moved = now.join(to("a"), "a").join(to("b"), "b").filter("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct()
        now = scratch.keep(moved, f"{name}-edges{k + 1}")
        scratch.drop(f"{name}-edges{k}", f"{name}-hooks{k}")
    out = rounds[0]
    for labels in rounds[1:]:
        out = out.join(labels.select(F.col("u").alias("l"), F.col("l").alias("m")), "l", "left").select("u", F.coalesce("m", "l").alias("l"))
    return out.select(F.col("u").alias("node"), F.col("l").alias("component"))
