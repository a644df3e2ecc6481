"""Fixed-point operators: reachability, levels, PageRank, betweenness.

A round is a join and an aggregation over the frontier; its result is written
to the shared checkpoint folder, so plans stay short and a lost executor costs
one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import blocks

#: Rounds after which what was reached becomes one table again.
EVERY = 8
#: Edge tables of up to this many rows are broadcast in each round, larger ones shuffled.
BROADCAST_EDGES = 200_000


def reach(edges: DataFrame, starts: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """origin, node, depth: what each origin reaches along source -> target, by least number of steps.

    An origin reaches itself only around a cycle. ``starts`` (origin, node) puts
    several nodes at depth 0 for an origin, none of which counts as reached;
    without it every source is its own origin and may be reached again.
    """
    step = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).distinct()
    if starts is None:
        frontier = cut(step.select(F.col("node").alias("origin"), F.col("next").alias("node")).withColumn("depth", F.lit(1)))
        seen, depth = frontier, 1
    else:
        frontier = cut(starts.select("origin", "node").distinct().withColumn("depth", F.lit(0)))
        seen, depth = frontier, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(step, "node").select("origin", F.col("next").alias("node")).distinct().join(seen, ["origin", "node"], "left_anti")
        frontier = cut(found.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % EVERY == 0:
            seen = cut(seen)
    return seen.where("depth > 0")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def reach_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """id, n, cyclic from arrays; None for graphs that these don't take."""
    ids = nodes.select(F.col("path").alias("id"))
    graph = blocks.arrays(ids, edges)
    if graph is not None:
        return blocks.reach_counts(nodes.sparkSession, graph)
    far = blocks.numbered(ids, edges)
    return None if far is None else blocks.far_reach_counts(far)


def blast_radius(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, blast_radius: how many files depend on each, directly or not; itself too, if it is on a cycle."""
    counts = reach_counts(nodes, reversed_edges(edges))
    if counts is not None:
        return counts.select(F.col("id").alias("path"), F.col("n").alias("blast_radius"))
    counted = reach(reversed_edges(edges)).groupBy(F.col("origin").alias("path")).agg(F.count(F.lit(1)).alias("blast_radius"))
    return nodes.select("path").join(counted, "path", "left").na.fill(0, ["blast_radius"])


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path of the files that lie on a cycle."""
    counts = reach_counts(nodes, edges)
    if counts is not None:
        return counts.where("cyclic").select(F.col("id").alias("path"))
    return reach(edges).where("origin = node").select(F.col("origin").alias("path"))


def pagerank(nodes: DataFrame, edges: DataFrame, weight: str | None = "weight", alpha: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, every: int = 5) -> DataFrame:
    """id, page_rank; ``nodes`` has id. Nodes without out-edges spread their rank over all.

    Ends when the summed change of a round is under nodes x ``tolerance`` (never,
    with tolerance 0), or after ``iterations`` rounds.
    """
    valued = edges.where(F.col(weight) > 0) if weight else edges
    graph = blocks.arrays(nodes, valued, weight)
    if graph is not None:
        return blocks.ranks(nodes.sparkSession, graph, alpha, iterations, tolerance, every)
    far = blocks.numbered(nodes, valued, weight)
    if far is not None:
        return blocks.far_ranks(far, alpha, iterations, tolerance, every)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    link = edges.select(F.col("source").alias("id"), "target", w.alias("w")).where("w > 0")
    out = link.groupBy("id").agg(F.sum("w").alias("total"))
    share = cut(link.join(out, "id").select("id", "target", (F.col("w") / F.col("total")).alias("share")))
    ids = cut(nodes.select("id"))
    loose = cut(ids.join(share.select("id"), "id", "left_anti"))
    n = ids.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("page_rank"))
    if share.count() <= BROADCAST_EDGES:
        share = F.broadcast(share)
    ends = loose.count()
    if 0 < ends <= BROADCAST_EDGES:
        loose = F.broadcast(loose)
    rank = ids.select("id", F.lit(1.0 / n).alias("r"))
    for k in range(1, iterations + 1):
        # a node's old rank travels with what it is given, so a round is one aggregation
        given = rank.join(share, "id").select(F.col("target").alias("id"), (F.col("r") * F.col("share")).alias("x"), F.lit(0.0).alias("old"))
        total = given.union(rank.select("id", F.lit(0.0), "r")).groupBy("id").agg(F.sum("x").alias("x"), F.sum("old").alias("old"))
        spread = F.lit(0.0)
        if ends:
            rest = rank.join(loose, "id", "left_semi").agg(F.sum("r").alias("rest"))
            total, spread = total.crossJoin(F.broadcast(rest)), F.col("rest") / n
        rank = total.select("id", ((1 - alpha) / n + alpha * (F.col("x") + spread)).alias("r"), "old")
        if k % every == 0 or k == iterations:
            rank = cut(rank)
            if tolerance and rank.agg(F.sum(F.abs(F.col("r") - F.col("old")))).first()[0] < n * tolerance:
                break
        rank = rank.select("id", "r")
    return rank.select("id", F.col("r").alias("page_rank"))


def betweenness(nodes: DataFrame, edges: DataFrame, normalized: bool = True) -> DataFrame:
    """id, betweenness on unweighted shortest paths, all sources level by level (Brandes).

    The forward rounds count shortest paths, the backward rounds hand
    dependencies from each level to the one before.
    """
    once = edges.select("source", "target").where("source <> target").distinct()
    graph = blocks.arrays(nodes, once)
    far = blocks.numbered(nodes, once) if graph is None else None
    sums = blocks.dependency_sums(nodes.sparkSession, graph) if graph is not None else blocks.far_dependency_sums(far) if far is not None else None
    if sums is not None:
        n = len(graph.ids) if graph is not None else far.n
        total = sums.withColumn("betweenness", F.col("x") / ((n - 1) * (n - 2) if normalized and n > 2 else 1))
        return nodes.select("id").join(total.drop("x"), "id", "left").na.fill(0.0, ["betweenness"])
    step = cut(once.toDF("v", "w"))
    level = cut(nodes.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("s", "v")
    while True:
        found = level.join(step, "v").groupBy("s", "w").agg(F.sum("paths").alias("paths")).withColumnRenamed("w", "v").join(seen, ["s", "v"], "left_anti")
        level = cut(found.select("s", "v", "paths"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.union(level.select("s", "v"))
        if len(levels) % EVERY == 0:
            seen = cut(seen)
    given = None  # s, w, paths, dependency of the level behind
    sums = []
    for d in range(len(levels) - 1, 0, -1):
        own = levels[d]
        if given is None:
            own = own.withColumn("dep", F.lit(0.0))
        else:
            back = own.join(step, "v").join(given, ["s", "w"]).groupBy("s", "v").agg(F.sum(F.col("paths") / F.col("far") * (1 + F.col("far_dep"))).alias("dep"))
            own = cut(own.join(back, ["s", "v"], "left").na.fill(0.0, ["dep"]))
        sums.append(own.select("v", "dep"))
        given = own.select("s", F.col("v").alias("w"), F.col("paths").alias("far"), F.col("dep").alias("far_dep"))
    n = nodes.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    if not sums:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    total = sums[0]
    for x in sums[1:]:
        total = total.union(x)
    total = total.groupBy(F.col("v").alias("id")).agg((F.sum("dep") * scale).alias("betweenness"))
    return nodes.select("id").join(total, "id", "left").na.fill(0.0, ["betweenness"])
