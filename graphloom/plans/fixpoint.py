"""Semi-naive fixpoints: a frontier is joined with edges until nothing is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept


def _merged(seen: DataFrame, depth: int, every: int = 8) -> DataFrame:
    """seen, written as one table every few rounds, so that long walks don't read a table for each round."""
    return kept(seen, "seen") if depth % every == 0 else seen


def reach(seed: DataFrame, edges: DataFrame, blocked: DataFrame | None = None, max_depth: int | None = None, stop_at: DataFrame | None = None) -> DataFrame:
    """(origin, node, depth): what each origin reaches over edges (src, dst), itself at depth 0, with the least depth.

    blocked nodes are neither entered nor left; nodes of stop_at are reached, but not left. Cycles end, since only
    pairs not seen before go on. Each round is one join, written to the shared folder.
    """
    seed = seed.select("origin", "node").distinct()
    if blocked is not None:
        blocked = kept(blocked.select(F.col(blocked.columns[0]).alias("node")).distinct(), "blocked")
        seed = seed.join(blocked, "node", "left_anti")
    steps = edges.select("src", "dst").distinct()
    if blocked is not None:
        steps = steps.join(blocked.withColumnRenamed("node", "dst"), "dst", "left_anti")
    steps = kept(steps.select("src", "dst"), "steps")
    frontier = kept(seed.select("origin", "node", F.lit(0).alias("depth")), "reach")
    seen, depth = frontier, 0
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        leave = frontier
        if stop_at is not None:
            leave = leave.join(stop_at.select(F.col(stop_at.columns[0]).alias("node")), "node", "left_anti")
        new = leave.join(steps, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        frontier = kept(new.join(seen, ["origin", "node"], "left_anti").select("origin", "node", F.lit(depth).alias("depth")), "reach")
        seen = _merged(seen.union(frontier), depth)
    return seen


def reached(seed: DataFrame, edges: DataFrame, blocked: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, depth): what any of seed (its first column) reaches; nodes are kept once, whoever reaches them."""
    return reach(seed.select(F.lit(0).alias("origin"), F.col(seed.columns[0]).alias("node")), edges, blocked, max_depth).select("node", "depth")


def closure(pairs: DataFrame) -> DataFrame:
    """Transitive closure of (a, b) by squaring: paths double, so the longest path costs its logarithm in rounds."""
    known = kept(pairs.select("a", "b").distinct(), "closure")
    n = known.count()
    while True:
        far = known.join(known.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        known = kept(known.union(far).distinct(), "closure")
        now = known.count()
        if now == n:
            return known
        n = now


def shortest_paths(seed: DataFrame, edges: DataFrame, targets: DataFrame, blocked: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(origin, node, depth, path): for each origin and target reached the least path, by length, then by ids.

    Only the nodes that the targets can be reached from are walked (a reverse pass comes first), and each pair
    (origin, node) keeps one path, so that cycles end without max_depth.
    """
    back = reached(targets, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), blocked, max_depth)
    useful = kept(back.select("node"), "useful")
    steps = kept(edges.select("src", "dst").distinct().join(useful.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "steps")
    frontier = kept(seed.select("origin", "node").distinct().join(useful, "node", "left_semi").select("origin", "node", F.lit(0).alias("depth"), F.array("node").alias("path")), "paths")
    seen, depth = frontier, 0
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        new = frontier.join(steps, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        new = new.groupBy("origin", "node").agg(F.min("path").alias("path")).join(seen, ["origin", "node"], "left_anti")
        frontier = kept(new.select("origin", "node", F.lit(depth).alias("depth"), "path"), "paths")
        seen = _merged(seen.union(frontier), depth)
    return seen.join(targets.select(F.col(targets.columns[0]).alias("node")).distinct(), "node", "left_semi").select("origin", "node", "depth", "path")
