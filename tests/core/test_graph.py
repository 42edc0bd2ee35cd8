"""Graph operators on small graphs with known answers, and against plain Python on random ones."""

import random
from collections import deque

import pandas as pd
import pytest

from basaltic.operators import graph


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")


def values(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_chain(spark):
    nodes, edges = frames(spark, "ABC", [("A", "B"), ("B", "C")])
    paths = graph.shortest_paths(nodes, edges)
    assert values(graph.betweenness(nodes, edges, paths), "betweenness") == {"A": 0, "B": 0.5, "C": 0}
    assert values(graph.closeness(nodes, paths), "closeness") == {"A": 0, "B": 0.5, "C": 0.75}
    assert values(graph.degrees(nodes, edges), "degree_centrality") == {"A": 0.5, "B": 1.0, "C": 0.5}


def test_hub(spark):
    nodes, edges = frames(spark, ["hub", "l1", "l2", "l3"], [("l1", "hub"), ("l2", "hub"), ("l3", "hub")])
    ranks = values(graph.page_rank(nodes, edges), "pagerank")
    assert ranks["hub"] > ranks["l1"] and sum(ranks.values()) == pytest.approx(1)
    summary = graph.network_summary(nodes, edges).first()
    assert (summary.nodes, summary.edges, summary.wcc_count, summary.wcc_largest) == (4, 3, 1, 4)


def test_isolated_and_repeated(spark):
    nodes, edges = frames(spark, "ABC", [("A", "A"), ("A", "B"), ("A", "B"), ("A", "external:x")])
    ranks = values(graph.page_rank(nodes, edges), "pagerank")
    assert ranks["C"] == 0 and sum(ranks.values()) == pytest.approx(1)
    summary = graph.network_summary(nodes, edges).first()
    assert (summary.edges, summary.wcc_count, summary.wcc_largest) == (1, 2, 2)
    assert summary.density == pytest.approx(1 / 6, abs=1e-6)
    fans = {r.id: (r.fan_in, r.fan_out, r.fan_out_external) for r in graph.fan_metrics(nodes, edges).collect()}
    assert fans == {"A": (1, 2, 1), "B": (1, 0, 0), "C": (0, 0, 0)}
    assert values(graph.degrees(nodes, edges), "degree_centrality") == {"A": 0.5, "B": 0.5, "C": 0}


def test_empty_and_single(spark):
    nodes, edges = frames(spark, [], [])
    summary = graph.network_summary(nodes, edges).first()
    assert tuple(summary) == (0, 0, 0.0, 0.0, 0, 0) and graph.network_metrics(nodes, edges).count() == 0
    nodes, edges = frames(spark, "A", [])
    assert values(graph.page_rank(nodes, edges), "pagerank") == {"A": 1.0}
    assert graph.network_summary(nodes, edges).first().wcc_count == 1 and graph.cycles(nodes, edges).count() == 0


def test_ring_and_cycles(spark):
    nodes, edges = frames(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "external:x"), ("d", "d")])
    assert [r.cycle for r in graph.cycles(nodes, edges).collect()] == [["a", "b", "c"]]
    ring = graph.network_metrics(*frames(spark, "ABC", [("A", "B"), ("B", "C"), ("C", "A")])).collect()
    assert len({tuple(r)[1:] for r in ring}) == 1


def test_reverse_reach(spark):
    _, edges = frames(spark, [], [("b", "a"), ("c", "b"), ("d", "c")])
    start = spark.createDataFrame([("a",)], "id string")
    assert values(graph.reverse_bfs(edges, start), "hops") == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert values(graph.reverse_bfs(edges, start, max_hops=1), "hops") == {"a": 0, "b": 1}


def test_random_components(spark):
    rng = random.Random(7)
    names = [f"n{i:02d}" for i in range(40)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(55)}
    nodes, edges = frames(spark, names, sorted(pairs))
    reach = {n: {n} for n in names}
    for _ in names:
        for a, b in pairs:
            for n in names:
                if a in reach[n]:
                    reach[n].add(b)
    want = {tuple(sorted(m for m in names if m in reach[n] and n in reach[m])) for n in names}
    assert {tuple(r.cycle) for r in graph.cycles(nodes, edges).collect()} == {c for c in want if len(c) > 1}


def by_queue(edges, starts, depth):
    """The walk one node at a time."""
    into = {}
    for src, dst, line, sure in sorted(edges, key=lambda e: (e[0], e[2])):
        into.setdefault(dst, []).append((src, line, sure))
    seen, found, cut = {s: True for s in starts}, {}, False
    queue = deque((s, 0) for s in sorted(starts))
    while queue:
        node, hops = queue.popleft()
        if hops == depth:
            cut |= any(s not in seen for s, _, _ in into.get(node, ()))
            continue
        for src, line, sure in into.get(node, ()):
            passes = seen[node] and sure
            entry = found.setdefault(src, [hops + 1, set(), False])
            entry[1].add(line)
            entry[2] |= passes
            if src not in seen:
                seen[src] = passes
                queue.append((src, hops + 1))
    return {n: (h, sorted(x), c) for n, (h, x, c) in found.items()}, cut


@pytest.mark.parametrize("depth", [1, 2, 10])
def test_walk(spark, depth):
    rng = random.Random(depth)
    names = [f"n{i:02d}" for i in range(25)]
    edges = sorted({(rng.choice(names), rng.choice(names), rng.randrange(1, 9), rng.random() < 0.7) for _ in range(60)})
    table = spark.createDataFrame(edges, "src string, dst string, line int, certain boolean")
    got, cut = graph.reverse_walk(table, spark.createDataFrame([("n00",), ("n01",)], "id string"), depth)
    want, want_cut = by_queue(edges, ["n00", "n01"], depth)
    assert {r.id: (r.hops, r.lines, r.certain) for r in got.collect()} == want
    assert cut.first().truncated == want_cut


def test_ancestors(spark):
    links = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "E")], "name string, base string")
    got = {(r.name, r.ancestor) for r in graph.ancestors(links).collect()}
    assert got == {(a, b) for a in "ABC" for b in "ABC"} | {("D", "D"), ("D", "E"), ("E", "E")}


@pytest.mark.parametrize("seed", [1, 2])
def test_one_task_and_many(spark, seed):
    """Ranks and strong components are the same in one task and in distributed rounds."""
    dice = random.Random(seed)
    names = [f"n{i}" for i in range(40)] + ["ä", "z"]
    nodes, edges = frames(spark, names, [(dice.choice(names), dice.choice(names)) for _ in range(48)] + [("n1", "external:x")])
    one, many = (values(graph.page_rank(nodes, edges, most_rounds=12, one_task_edges=k), "pagerank") for k in (100, 0))
    assert one == pytest.approx(many, abs=1e-12) and len(one) == 42
    one, many = (values(graph.strong_components(nodes, edges, one_task_edges=k), "component") for k in (100, 0))
    assert one == many and one


def test_one_task_components(spark):
    """Against reachability, on graphs of numbers, a long path back and forth among them."""
    dice = random.Random(3)
    graphs = [[(dice.randrange(12), dice.randrange(12)) for _ in range(dice.randrange(1, 30))] for _ in range(200)]
    for edges in [*graphs, [(i, i + 1) for i in range(50)] + [(50, 20)], []]:
        edges = [(a, b) for a, b in edges if a != b]
        reach = {a: {a} for a in {n for e in edges for n in e}}
        for _ in reach:
            for a, b in edges:
                reach[a] |= reach[b]
        want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if any(a in reach[b] for b in reach[a] - {a})}
        (got,) = graph._strong(iter([pd.DataFrame(edges, columns=["src", "dst"])]))
        assert dict(zip(got["id"], got["component"])) == want
