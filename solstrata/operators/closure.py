"""Closures of edge tables: ancestors, reachability, cycles, simple paths.

Closures double or extend paths by joins until nothing new comes, each round written to the shared folder, so they
survive lost executors and have no depth limit but the one asked for. Cycles end by themselves, since a pair that is known is
not extended again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstrata.session import materialize


def closure(edges: DataFrame, source: str, target: str, keys: Sequence[str] = (), max_depth: int | None = None) -> DataFrame:
    """(keys..., source, target, depth): all pairs joined by a path of one or more edges, with the length of the shortest.

    Edges with a null end take no part. A node reaches itself only if it lies on a cycle.
    """
    keys = list(keys)
    step = edges.select(*keys, F.col(source).alias("s"), F.col(target).alias("t")).where("s is not null and t is not null").distinct()
    step = materialize(step, "closure-edges")
    known = front = materialize(step.withColumn("depth", F.lit(1)), "closure")
    depth = 1
    while (max_depth is None or depth < max_depth) and front.limit(1).count():
        depth += 1
        further = front.withColumnRenamed("t", "mid").join(step.withColumnRenamed("s", "mid"), [*keys, "mid"]).select(*keys, "s", "t").distinct()
        front = materialize(further.join(known.select(*keys, "s", "t"), [*keys, "s", "t"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        known = known.unionByName(front)
    return known.select(*keys, F.col("s").alias(source), F.col("t").alias(target), "depth")


def cycles(pairs: DataFrame, source: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., node, component, size): nodes of strongly connected components of two or more nodes, named by their least node.

    pairs is a closure; two nodes are in one component if they reach each other.
    """
    keys = list(keys)
    forth = pairs.select(*keys, F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b")
    mutual = forth.join(forth.select(*keys, F.col("a").alias("b"), F.col("b").alias("a")), [*keys, "a", "b"])
    named = mutual.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"), (F.count_distinct("b") + 1).alias("size"))
    return named


def simple_paths(edges: DataFrame, source: str, target: str, keys: Sequence[str] = (), max_depth: int = 20) -> DataFrame:
    """(keys..., source, target, path): all paths without a repeated node of at most max_depth edges."""
    keys = list(keys)
    step = edges.select(*keys, F.col(source).alias("s"), F.col(target).alias("t")).where("s <> t").distinct()
    front = materialize(step.withColumn("path", F.array("s", "t")), "paths")
    known = front
    for _ in range(max_depth - 1):
        longer = front.withColumnRenamed("t", "mid").join(step.select(*keys, F.col("s").alias("mid"), "t"), [*keys, "mid"])
        front = materialize(longer.where(~F.array_contains("path", F.col("t"))).select(*keys, "s", "t", F.concat("path", F.array("t")).alias("path")), "paths")
        if not front.limit(1).count():
            break
        known = known.unionByName(front)
    return known.select(*keys, F.col("s").alias(source), F.col("t").alias(target), "path")
