"""Graph operators over plain ``nodes(id)`` and ``edges(src, dst)`` DataFrames.

Loops keep their state in written tables, a new one each round, so that plans stay short and a
lost executor costs a reread. Nothing is gathered per node but sums and minima, which Spark
combines before it shuffles; joins read plain tables, so that adaptive execution can split a
hub's rows. Ranks and strong components of a graph of at most ``ONE_TASK_EDGES`` counted edges
are found in one task instead, since rounds of jobs would cost more than all their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltic.storage import drop_scratch, materialize, saved

DAMPING, TOLERANCE, MOST_ROUNDS = 0.85, 1e-10, 200
#: Edges that one task may hold: about 200 bytes each.
ONE_TASK_EDGES = 500_000


def _gathered(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, in order, and the edges as places in them."""
    rows = pd.concat([pd.DataFrame({"src": [], "dst": []}, dtype=object), *batches])
    codes, ids = pd.factorize(pd.concat([rows["src"], rows["dst"]]), sort=True)
    edges = np.unique(np.stack([codes[len(rows) :], codes[: len(rows)]], 1), axis=0)
    return np.asarray(ids), edges[:, 1], edges[:, 0]


def simple_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between two different known nodes."""
    known = nodes.select("id")
    return (
        edges.select("src", "dst")
        .where("src <> dst")
        .join(known.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
        .select("src", "dst")
        .distinct()
    )


def build_graphs(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The file graph (imports) and the symbol graph (all other kinds)."""
    return edges.where("kind = 'import'"), edges.where("kind <> 'import'")


def neighbours(edges: DataFrame, node: str, kinds: list[str] | None = None, incoming: bool = False) -> DataFrame:
    """Distinct successors (or predecessors) of ``node``, in order."""
    here, there = ("dst", "src") if incoming else ("src", "dst")
    rows = edges.where(F.col(here) == node)
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    return rows.select(F.col(there).alias("id")).distinct().orderBy("id")


def fan_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out, fan_out_external: distinct partners; a self-loop counts in both."""
    known = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("internal"))
    pairs = edges.select("src", "dst").distinct().join(known, "dst", "left")
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count_if("internal").alias("fan_out"), F.count_if(F.col("internal").isNull()).alias("fan_out_external"))
    into = pairs.where("internal").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    joined = nodes.select("id").join(into, "id", "left").join(out, "id", "left")
    return joined.select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out", "fan_out_external")])


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree_centrality = (in + out) / (n - 1)."""
    pairs = simple_edges(nodes, edges)
    ends = pairs.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(pairs.select("dst", F.lit(0), F.lit(1)))
    counted = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = nodes.count()
    joined = nodes.select("id").join(counted, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree")])
    return joined.withColumn("degree_centrality", F.round((F.col("in_degree") + F.col("out_degree")) / F.lit(float(max(n - 1, 1))), 6))


def network_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, avg_degree, wcc_count, wcc_largest."""
    pairs = simple_edges(nodes, edges)
    sizes = weak_components(nodes, edges).groupBy("component").count()
    parts = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(sizes.agg(F.count(F.lit(1)).alias("wcc_count"), F.coalesce(F.max("count"), F.lit(0)).alias("wcc_largest")))
    n, m = F.col("nodes").cast("double"), F.col("edges").cast("double")
    return parts.select(
        "nodes",
        "edges",
        F.when(F.col("nodes") > 1, F.round(m / F.greatest(n * (n - 1), F.lit(1.0)), 6)).otherwise(0.0).alias("density"),
        F.when(F.col("nodes") > 0, F.round(m / F.greatest(n, F.lit(1.0)), 6)).otherwise(0.0).alias("avg_degree"),
        "wcc_count",
        "wcc_largest",
    )


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, component) for every node of undirected ``edges`` (a, b); component is the
    smallest node reachable. Nulls and self-loops are ignored; no edges give no rows.

    Each round points every node at its smallest neighbour, shortens the pointers to their
    roots by doubling, and contracts the edges to roots; the nodes of a component at least
    halve per round.
    """
    spark = edges.sparkSession
    edges, path = materialize(edges.select("a", "b").where("a <> b").distinct(), f"{tag}-edges")
    labels, label_path = None, None
    while labels is None or not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        pointers, pointer_path = materialize(least.select("v", F.least("v", "m").alias("p")), f"{tag}-pointers")
        moved = not pointers.isEmpty()
        while moved:
            up = pointers.select(F.col("v").alias("p"), F.col("p").alias("q"))
            nearer, nearer_path = materialize(pointers.join(up, "p").select("v", "p", "q"), f"{tag}-pointers")
            moved = not nearer.where("p <> q").isEmpty()
            pointers = nearer.select("v", F.col("q").alias("p"))
            drop_scratch(spark, pointer_path)
            pointer_path = nearer_path
        if labels is None:
            labels, label_path = pointers.select(F.col("v").alias("node"), F.col("p").alias("component")), pointer_path
        else:
            step = pointers.select(F.col("v").alias("component"), F.col("p").alias("further"))
            joined = labels.join(step, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
            labels, joined_path = materialize(joined, f"{tag}-labels")
            drop_scratch(spark, label_path)
            drop_scratch(spark, pointer_path)
            label_path = joined_path
        contracted = (
            edges.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ra")), "a")
            .join(labels.select(F.col("node").alias("b"), F.col("component").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            .distinct()
        )
        edges, contracted_path = materialize(contracted, f"{tag}-edges")
        drop_scratch(spark, path)
        path = contracted_path
    drop_scratch(spark, path)
    return labels


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node, isolated ones included."""
    pairs = simple_edges(nodes, edges)
    found = connected_components(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def reverse_bfs(edges: DataFrame, starts: DataFrame, kinds: list[str] | None = None, max_hops: int = 10) -> DataFrame:
    """(id, hops) of every node from which a start can be reached; starts have 0 hops."""
    if kinds:
        edges = edges.where(F.col("kind").isin(kinds))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("next")).distinct()
    seen = saved(starts.select("id").distinct().withColumn("hops", F.lit(0)), "bfs")
    frontier = seen
    for hop in range(1, max_hops + 1):
        step = frontier.join(back, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")
        frontier = saved(step.withColumn("hops", F.lit(hop)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def reverse_walk(edges: DataFrame, starts: DataFrame, max_depth: int = 10, tags: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Who depends on ``starts(id)`` through ``edges(src, dst, line, certain)``.

    Returns (id, hops, lines, certain) of the nodes with an edge into something reached, and
    one row (truncated). ``lines`` holds every line of such edges. A node passes on the
    certainty of the edge that found it first (its finder's place in the queue, then source
    and line), and is itself certain if any edge into the walk from it is, together with what
    that edge's target passes on.

    ``tags`` are columns of starts that tell walks apart: all walks take the same rounds, each
    goes as if alone, and its tags stand before id. truncated says whether any was cut short.
    """
    edges = edges.select("src", F.col("dst").alias("id"), "line", "certain")
    seen = saved(_queued(starts.select(*tags, "id").distinct(), "id").select(*tags, "id", F.lit(0).alias("hops"), "pos", F.lit(True).alias("passes")), "walk")
    frontier, hits = seen, None
    for hop in range(1, max_depth + 1):
        found = frontier.join(edges, "id").select(*tags, "src", F.struct("pos", "src", "line").alias("at"), "line", (F.col("passes") & F.col("certain")).alias("sure"))
        found = saved(found, "walk")
        if found.isEmpty():
            frontier = None
            break
        one = found.groupBy(*tags, "src").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.bool_or("sure").alias("certain"), F.min_by("sure", "at").alias("passes"), F.min("at").alias("at"))
        one = saved(one.withColumn("hops", F.lit(hop)), "walk")
        hits = one if hits is None else hits.union(one)
        fresh = one.join(seen.select(*tags, F.col("id").alias("src")), [*tags, "src"], "left_anti")
        frontier = saved(_queued(fresh, "at").select(*tags, F.col("src").alias("id"), F.lit(hop).alias("hops"), "pos", "passes"), "walk")
        seen = seen.union(frontier)
    truncated = False
    if frontier is not None:
        beyond = frontier.select(*tags, "id").join(edges.select("src", "id"), "id").join(seen.select(*tags, F.col("id").alias("src")), [*tags, "src"], "left_anti")
        truncated = not beyond.isEmpty()
    if hits is None:
        reached = seen.limit(0).select(*tags, "id", "hops", F.array().cast("array<int>").alias("lines"), F.lit(True).alias("certain"))
    else:
        reached = hits.groupBy(*tags, F.col("src").alias("id")).agg(F.min("hops").alias("hops"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"), F.bool_or("certain").alias("certain"))
    return reached, edges.sparkSession.range(1).select(F.lit(truncated).alias("truncated"))


def _queued(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``pos``, which rises with ``column``: after a distributed sort the numbers
    of partitions and of rows in them do."""
    return rows.orderBy(column).withColumn("pos", F.monotonically_increasing_id())


def _strong(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strong components of two nodes or more, by one depth-first search."""
    ids, src, dst = _gathered(batches)
    order = np.argsort(src, kind="stable")
    first, after = np.searchsorted(src[order], np.arange(len(ids) + 1)).tolist(), dst[order].tolist()
    entered, low, open_at = [0] * len(ids), [0] * len(ids), [False] * len(ids)
    clock, path, found = 0, [], []
    for root in range(len(ids)):
        todo = [] if entered[root] else [(root, first[root])]
        while todo:
            node, at = todo.pop()
            if not entered[node]:
                clock += 1
                entered[node] = low[node] = clock
                path.append(node)
                open_at[node] = True
            elif at > first[node]:  # back from a successor
                low[node] = min(low[node], low[after[at - 1]]) if open_at[after[at - 1]] else low[node]
            while at < first[node + 1] and entered[after[at]]:
                if open_at[after[at]]:
                    low[node] = min(low[node], entered[after[at]])
                at += 1
            if at < first[node + 1]:
                todo += [(node, at + 1), (after[at], first[after[at]])]
            elif low[node] == entered[node]:
                members = []
                while not members or members[-1] != node:
                    members.append(path.pop())
                    open_at[members[-1]] = False
                if len(members) > 1:
                    found += [(m, min(members)) for m in members]
    yield pd.DataFrame({"id": ids[[m for m, _ in found]], "component": ids[[c for _, c in found]]})


def strong_components(nodes: DataFrame, edges: DataFrame, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, component) of the nodes on a cycle of two nodes or more; component is the smallest
    member. Beyond ``one_task_edges``, nodes that no cycle can hold are trimmed; then every node
    takes the smallest node that reaches it as its colour, and of each colour the nodes that
    reach that node are one component. The rest goes another round."""
    pairs = saved(simple_edges(nodes, edges), "scc-edges")
    kind = pairs.schema["src"].dataType.simpleString()
    if pairs.count() <= one_task_edges:
        return saved(pairs.coalesce(1).mapInPandas(_strong, f"id {kind}, component {kind}"), "scc-found")
    done = None
    while True:
        while True:  # trim
            both = pairs.select(F.col("src").alias("id")).distinct().intersect(pairs.select(F.col("dst").alias("id")).distinct())
            both = saved(both, "scc-live")
            inner = pairs.join(both.withColumnRenamed("id", "src"), "src", "left_semi").join(both.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
            before, inner = pairs.count(), saved(inner, "scc-edges")
            pairs = inner
            if inner.count() == before:
                break
        if pairs.isEmpty():
            break
        colour = saved(both.select("id", F.col("id").alias("colour")), "scc-colour")
        while True:
            sent = pairs.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("got"))
            new = saved(colour.join(sent, "id", "left").select("id", F.least("colour", F.coalesce("got", "colour")).alias("colour"), (F.col("got") < F.col("colour")).alias("moved")), "scc-colour")
            moved = not new.where("moved").isEmpty()
            colour = new.select("id", "colour")
            if not moved:
                break
        same = pairs.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst")
        back = reverse_bfs(saved(same, "scc-same"), colour.where("id = colour").select("id"), max_hops=1 << 30)
        found = saved(back.join(colour, "id").select("id", F.col("colour").alias("component")), "scc-found")
        done = found if done is None else done.union(found)
        pairs = saved(pairs.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"), "scc-edges")
    if done is None:
        return nodes.limit(0).select("id", F.col("id").alias("component"))
    large = done.groupBy("component").count().where("count > 1").select("component")
    return done.join(large, "component", "left_semi").select("id", "component")


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (cycle) per strong component of two nodes or more: its sorted members."""
    return strong_components(nodes, edges).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("cycle")).select("cycle")


def _ranked(damping: float, tolerance: float, most_rounds: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, src, dst = _gathered(batches)
        n = len(ids)
        out = np.bincount(src, minlength=n)
        ranks = np.full(n, 1.0 / max(n, 1))
        for _ in range(most_rounds if n else 0):
            got = np.bincount(dst, (ranks / np.maximum(out, 1))[src], n)
            new = (1 - damping) / n + damping * (got + ranks[out == 0].sum() / n)
            change, ranks = np.abs(new - ranks).sum(), new
            if change < tolerance:
                break
        yield pd.DataFrame({"id": ids, "rank": ranks})

    return run


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """(id, pagerank). Isolated nodes get 0 and stand outside the sum, unless all are isolated:
    then each has 1/n. What nodes without successors hold is spread evenly. The loop ends when
    the ranks' absolute changes sum to less than ``tolerance``. Beyond ``one_task_edges`` each
    round is a distributed join."""
    pairs = saved(simple_edges(nodes, edges), "rank-edges")
    if 0 < pairs.count() <= one_task_edges:
        kind = pairs.schema["src"].dataType.simpleString()
        ranks = saved(pairs.coalesce(1).mapInPandas(_ranked(damping, tolerance, most_rounds), f"id {kind}, rank double"), "rank")
        return nodes.select("id").join(ranks, "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("pagerank"))
    out = pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    active = saved(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")).distinct().join(out, "id", "left"), "rank-nodes")
    n, total = active.count(), nodes.count()
    if not n:
        return nodes.select("id", F.lit(1.0 / total if total else 0.0).alias("pagerank"))
    ranks = active.select("id", "out", F.lit(1.0 / n).alias("rank"))
    dangling = ranks.where("out is null").agg(F.sum("rank")).first()[0] or 0.0
    for _ in range(most_rounds):
        base = (1 - damping) / n + damping * dangling / n
        given = pairs.join(ranks.where("out is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("share")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("got"))
        new = ranks.join(given, "id", "left").select("id", "out", (F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("new"), "rank")
        new = saved(new, "rank")
        state = new.agg(F.sum(F.abs(F.col("new") - F.col("rank"))).alias("change"), F.sum(F.when(F.col("out").isNull(), F.col("new"))).alias("dangling")).first()
        ranks, dangling = new.select("id", "out", F.col("new").alias("rank")), state["dangling"] or 0.0
        if state["change"] < tolerance:
            break
    return nodes.select("id").join(ranks.select("id", "rank"), "id", "left").select("id", F.coalesce("rank", F.lit(0.0)).alias("pagerank"))


def shortest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, id, dist, paths): hops and number of shortest paths from each source to each
    node it reaches, itself at 0. As many rows as there are reachable pairs."""
    pairs = saved(simple_edges(nodes, edges), "path-edges")
    seen = saved(nodes.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("paths")), "path")
    frontier, dist = seen, 0
    while True:
        dist += 1
        step = frontier.join(pairs.withColumnRenamed("src", "id"), "id").groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        step = step.join(seen.select("source", "id"), ["source", "id"], "left_anti")
        frontier = saved(step.select("source", "id", F.lit(dist).alias("dist"), "paths"), "path")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def closeness(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, closeness): the sum of 1/d over all nodes from which the node is reached, by n-1."""
    n = nodes.count()
    summed = paths.where("dist > 0").groupBy("id").agg(F.sum(1.0 / F.col("dist")).alias("total"))
    return nodes.select("id").join(summed, "id", "left").select("id", (F.coalesce("total", F.lit(0.0)) / F.lit(float(max(n - 1, 1)))).alias("closeness"))


def betweenness(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, betweenness), directed, by (n-1)(n-2): dependencies are summed from the farthest
    level of each source's shortest paths to the nearest, all sources at once."""
    n = nodes.count()
    if n < 3:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    pairs = saved(simple_edges(nodes, edges), "path-edges")
    paths = saved(paths, "path-all")
    deepest = paths.agg(F.max("dist")).first()[0] or 0
    total, below = None, paths.where(F.col("dist") == deepest).select("source", "id", "paths", F.lit(0.0).alias("delta"))
    for dist in range(deepest - 1, 0, -1):
        near = paths.where(F.col("dist") == dist).select("source", F.col("id").alias("src"), F.col("paths").alias("sigma"))
        far = below.select("source", F.col("id").alias("dst"), ((1.0 + F.col("delta")) / F.col("paths")).alias("each"))
        given = near.join(pairs, "src").join(far, ["source", "dst"]).groupBy("source", "src").agg(F.sum(F.col("sigma") * F.col("each")).alias("delta"))
        level = near.join(given, ["source", "src"], "left").select("source", F.col("src").alias("id"), F.col("sigma").alias("paths"), F.coalesce("delta", F.lit(0.0)).alias("delta"))
        below = saved(level, "path-delta")
        part = below.select("id", "delta")
        total = part if total is None else total.union(part)
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    summed = total.groupBy("id").agg(F.sum("delta").alias("total"))
    return nodes.select("id").join(summed, "id", "left").select("id", (F.coalesce("total", F.lit(0.0)) / F.lit(float((n - 1) * (n - 2)))).alias("betweenness"))


def network_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id with pagerank, betweenness, closeness, degree_centrality, rounded to six places."""
    paths = shortest_paths(nodes, edges)
    joined = page_rank(nodes, edges).join(betweenness(nodes, edges, paths), "id").join(closeness(nodes, paths), "id").join(degrees(nodes, edges), "id")
    return joined.select("id", *[F.round(c, 6).alias(c) for c in ("pagerank", "betweenness", "closeness", "degree_centrality")])


def ancestors(links: DataFrame) -> DataFrame:
    """(name, ancestor): the transitive closure of ``links(name, base)``, each name included,
    however deep; it ends as each round adds pairs or is the last."""
    links = saved(links.select("name", "base").distinct(), "ancestor-links")
    names = links.select("name").union(links.select("base")).distinct()
    found = saved(names.select("name", F.col("name").alias("ancestor")), "ancestors")
    frontier = found
    while True:
        step = frontier.join(links.select(F.col("name").alias("ancestor"), "base"), "ancestor").select("name", F.col("base").alias("ancestor")).distinct()
        frontier = saved(step.join(found, ["name", "ancestor"], "left_anti"), "ancestors")
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    return found


def dst_class(dst: Column) -> Column:
    """What a reference points at: ``external``, ``unresolved`` or ``internal``."""
    return F.when(dst.startswith("external:"), "external").when(dst.startswith("unresolved:"), "unresolved").otherwise("internal")
