"""Circular dependencies and communities.

Both decide in an order that only exists within a weakly connected component,
so components are told apart by joins and each is one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.components import connected_components
from ..functions.lineage import cut

MOST = 100


def cyclic_core(edges: DataFrame) -> DataFrame:
    """source, target of the edges whose ends both lead to a cycle: dead ends are trimmed until none is left."""
    now = cut(edges.select("source", "target").where("source <> target").distinct())
    n = now.count()
    while n:
        now = cut(now.join(now.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
        left = now.count()
        if left == n:
            break
        n = left
    return now


def _components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component over string ids, by their order numbers."""
    a, b = ids.select(F.col("id").alias("source"), F.col("ord").alias("a")), ids.select(F.col("id").alias("target"), F.col("ord").alias("b"))
    found = connected_components(edges.join(a, "source").join(b, "target").select("a", "b"))
    return ids.join(found.withColumnRenamed("node", "ord"), "ord").select("id", "ord", "component")


def search_cycles(edges: list[tuple[int, int]], most: int = MOST) -> list[tuple[int, list[int]]]:
    """(root, nodes of a closed walk) of every back edge of one depth-first search; roots and neighbours in the given order."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    done: set[int] = set()
    cycles = []
    for root in sorted({x for e in edges for x in e}):
        if root in done:
            continue
        done.add(root)
        path, place = [root], {root: 0}
        todo = [iter(out.get(root, ()))]
        while todo:
            for b in todo[-1]:
                if b in place:
                    cycles.append((root, [*path[place[b] :], b]))
                    if len(cycles) >= most:
                        return cycles
                elif b not in done:
                    done.add(b)
                    place[b] = len(path)
                    path.append(b)
                    todo.append(iter(out.get(b, ())))
                    break
            else:
                todo.pop()
                del place[path.pop()]
    return cycles


def circular_dependencies(files: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """cycle (paths, the first repeated at the end), severity, rank. ``files`` has path and ord, ``edges`` ord.

    The first ``most`` back edges of one search over all files in their order
    count, less those that close a cycle found before.
    """
    ids = files.select(F.col("path").alias("id"), "ord")
    core = cyclic_core(edges)
    order = edges.groupBy("source", "target").agg(F.min("ord").alias("e"))
    comp = _components(ids, core)
    a, b = comp.select(F.col("id").alias("source"), F.col("ord").alias("a"), "component"), comp.select(F.col("id").alias("target"), F.col("ord").alias("b"))
    rows = core.join(order, ["source", "target"]).join(a, "source").join(b, "target").select("component", "a", "b", "e")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("e")
        found = search_cycles(list(zip(pdf.a.tolist(), pdf.b.tolist())), most)
        return pd.DataFrame({"root": [r for r, _ in found], "seq": range(len(found)), "walk": [w for _, w in found]})

    walks = rows.groupBy("component").applyInPandas(search, "root long, seq long, walk array<long>").orderBy("root", "seq").limit(most)
    walks = walks.withColumn("rank", F.row_number().over(Window.orderBy("root", "seq")))  # ``most`` rows
    named = walks.select("rank", F.posexplode("walk").alias("pos", "ord")).join(ids, "ord").groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("cycle"))
    once = named.withColumn("ring", F.slice("cycle", 1, F.size("cycle") - 1)).withColumn("at", F.array_position("ring", F.array_min("ring")).cast("int"))
    turned = F.concat(F.slice("ring", F.col("at"), F.size("ring")), F.slice("ring", 1, F.col("at") - 1))
    first = F.row_number().over(Window.partitionBy("key").orderBy("rank"))
    kept = once.withColumn("key", F.array_join(turned, " -> ")).withColumn("n", first).where("n = 1")
    return kept.select("rank", "cycle", F.when(F.size("cycle") > 3, "HIGH").otherwise("LOW").alias("severity"))


def louvain(edges: list[tuple[int, int, float]], rounds: int = 100) -> dict[int, int]:
    """Community of each node of an undirected weighted graph; nodes move in id order, so the result is fixed."""
    label = {x: x for e in edges for x in e[:2]}
    graph = {x: {} for x in label}
    for a, b, w in edges:
        graph[a][b] = graph[a].get(b, 0.0) + w
        graph[b][a] = graph[b].get(a, 0.0) + w
    while True:
        total = sum(sum(n.values()) for n in graph.values())
        degree = {x: sum(n.values()) for x, n in graph.items()}
        of, held = {x: x for x in graph}, dict(degree)
        moved_ever = False
        for _ in range(rounds):
            moved = False
            for x in sorted(graph):
                old, links = of[x], {}
                for y, w in graph[x].items():
                    if y != x:
                        links[of[y]] = links.get(of[y], 0.0) + w
                held[old] -= degree[x]
                gain = lambda c: links.get(c, 0.0) - held[c] * degree[x] / total  # noqa: B023, E731
                best = max([old, *sorted(links)], key=lambda c: (gain(c) + (1e-12 if c == old else 0.0), -c))
                held[best] += degree[x]
                if best != old:
                    of[x], moved, moved_ever = best, True, True
            if not moved:
                break
        if not moved_ever:
            return label
        label = {x: of[c] for x, c in label.items()}
        merged: dict[int, dict[int, float]] = {c: {} for c in set(of.values())}
        for x, n in graph.items():
            for y, w in n.items():
                a, b = of[x], of[y]
                merged[a][b] = merged[a].get(b, 0.0) + w
        graph = merged


def clusters(files: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster_id, name, files, file_count, cohesion; every file is in one cluster.

    An edge and its reverse are one link, with the weight of whichever comes first.
    """
    ids = files.select(F.col("path").alias("id"), "ord")
    a, b = ids.select(F.col("id").alias("source"), F.col("ord").alias("a")), ids.select(F.col("id").alias("target"), F.col("ord").alias("b"))
    links = cut(edges.join(a, "source").join(b, "target").where("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min_by("weight", edges["ord"]).cast("double").alias("w")))
    comp = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "x")

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        found = louvain(list(zip(pdf.x.tolist(), pdf.y.tolist(), pdf.w.tolist())))
        return pd.DataFrame({"ord": list(found), "cluster": list(found.values())})

    member = links.join(comp, "x").groupBy("component").applyInPandas(part, "ord long, cluster long")
    member = cut(files.select("path", "module", "ord").join(member, "ord", "left").withColumn("cluster", F.coalesce("cluster", "ord")))
    within = member.select("path", "cluster")
    ends = edges.join(within.toDF("source", "c"), "source").join(within.toDF("target", "d"), "target")
    inner = ends.groupBy(F.col("c").alias("cluster")).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("c") == F.col("d")).alias("own"))
    tally = member.groupBy("cluster", "module").agg(F.count(F.lit(1)).alias("k"), F.min("ord").alias("o"))
    names = tally.groupBy("cluster").agg(F.min_by("module", F.struct(-F.col("k"), "o")).alias("name"))
    listed = member.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("files"))
    count = F.size("files")
    cohesion = F.when(count <= 1, 1.0).when(F.coalesce("all", F.lit(0)) == 0, 0.0).otherwise(F.col("own") / F.col("all"))
    return listed.join(names, "cluster").join(inner, "cluster", "left").select(F.concat(F.lit("cluster-"), "cluster").alias("cluster_id"), "name", "files", count.alias("file_count"), cohesion.alias("cohesion"))
