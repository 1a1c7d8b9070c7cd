import random

import pytest

from graphloom.operators import degree, filters, recursion
from graphloom.plans import report
from graphloom.plans.fixpoint import star_components


def made(spark, n, pairs, kinds=None, files=None):
    nodes = spark.createDataFrame([(i, i, f"n{i}", "function", (files or {}).get(i, "src/a.ts")) for i in range(n)], "id long, node_seq long, name string, kind string, file_path string")
    edges = spark.createDataFrame([(k, (kinds or {}).get(k, "call"), u, v) for k, (u, v) in enumerate(pairs)], "edge_seq long, kind string, src long, dst long")
    return nodes, edges


def random_pairs(seed, n=14, m=18):
    r = random.Random(seed)
    return [(r.randrange(n + 2), r.randrange(n + 2)) for _ in range(m)]  # n and n + 1 are unknown nodes


def closure(pairs, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        x = todo.pop()
        for u, v in pairs:
            if u == x and v not in seen:
                seen.add(v)
                todo.append(v)
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_both_ways_agree(spark, seed):
    n, pairs = 14, random_pairs(seed)
    nodes, edges = made(spark, n, pairs)
    seeds = nodes.where("id < 2")
    want = closure(pairs, {0, 1})
    strong = {x: min(y for y in range(n + 2) if y in closure(pairs, {x}) and x in closure(pairs, {y})) for x in range(n + 2)}
    size = {r: sum(s == r for s in strong.values()) for r in strong.values()}
    both = [(u, v) for u, v in pairs if u < n and v < n] + [(v, u) for u, v in pairs if u < n and v < n]
    touched = {x for p in pairs for x in p}
    comp = {x: min(closure(both, {x})) if x in touched else None for x in range(n)}
    for small in (True, False):
        assert {r["id"] for r in recursion.reachable(edges, seeds, small).collect()} == want
        assert {r["node"]: r["root"] for r in recursion.strong_components(edges, small).collect()} == {x: r for x, r in strong.items() if size[r] > 1}
        assert {r["id"]: r["root"] for r in recursion.components(nodes, edges, small).collect()} == comp


def layer_oracle(n, pairs):
    before = {x: {u for u, v in pairs if v == x and u != x and u < n} for x in range(n)}
    free = {}
    while True:
        new = {x: max([free[u] + 1 for u in before[x]], default=0) for x in range(n) if x not in free and all(u in free for u in before[x])}
        if not new:
            break
        free |= new
    known = dict(free)
    for x in range(n):
        if x not in free and before[x] & set(free):
            known[x] = max(free[u] for u in before[x] & set(free)) + 1
    last = max(known.values(), default=0)
    return {x: known.get(x, last + 1) for x in range(n)}


@pytest.mark.parametrize("pairs", [[(0, 1), (1, 2), (0, 2), (2, 3)], [(0, 1), (1, 0)], [(0, 1), (1, 2), (2, 1), (2, 3)], [(0, 0), (0, 1)], random_pairs(5)])
def test_layers(spark, pairs):
    n = 6
    nodes, edges = made(spark, n, pairs)
    one = nodes.selectExpr("id", "'c' cluster_id")
    for small in (True, False):
        assert {r["id"]: r["layer"] for r in recursion.layers(nodes, edges, one, small).collect()} == layer_oracle(n, pairs)


def paths_oracle(pairs, target, most=25, longest=10):
    out, cut = [], False

    def go(path):
        nonlocal cut
        more = [u for u, v in pairs if v == path[0] and u not in path]
        if not more:
            out.append(path)
        elif len(path) == longest:
            cut = True
        else:
            for u in more:
                go([u, *path])

    go([target])
    return (out or [[target]])[:most], cut or len(out) > most


CHAIN = lambda n: [(i + 1, i) for i in range(n - 1)]


@pytest.mark.parametrize("pairs", [[], CHAIN(10), CHAIN(11), [(1, 0), (1, 0), (2, 1)], [(1, 0), (0, 1)], [(i, 0) for i in range(1, 26)], [(i, 0) for i in range(1, 27)]])
def test_call_paths(spark, pairs):
    _, edges = made(spark, 30, pairs)
    got = recursion.call_paths(edges, 0).orderBy("place").collect()
    want, truncated = paths_oracle(pairs, 0)
    assert [[int(x) for x in r["path"].split(">")] for r in got] == want
    assert all(r["truncated"] == truncated for r in got)


def test_k_hop(spark):
    _, edges = made(spark, 5, [(0, 1), (1, 2), (2, 0), (3, 0)])
    got = {(r["id"], r["direction"]): r["depth"] for r in recursion.k_hop(edges, 0, 2).collect()}
    assert got == {(1, "out"): 1, (2, "out"): 2, (2, "in"): 1, (3, "in"): 1, (1, "in"): 2}


def test_clusters_and_unknown_nodes(spark):
    # 0-1 and 2-3 share the unknown node 9, which connects nothing; 4 is touched by a self-loop only; 5 by nothing
    nodes, edges = made(spark, 6, [(0, 1), (2, 3), (1, 9), (3, 9), (4, 4)], files={2: "src/e.ts"})
    for small in (True, False):
        got = {r["id"]: r["cluster_id"] for r in recursion.clusters(nodes, edges, nodes.where("file_path = 'src/e.ts'").select("id"), small).collect()}
        assert got == {2: "ep_0", 3: "ep_0", 0: "cmp_0", 1: "cmp_0", 4: "cmp_1", 5: "orphans"}


def test_star_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    e = spark.createDataFrame(pairs, "u long, v long")
    got = {r["node"]: r["root"] for r in star_components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_degrees(spark):
    nodes, edges = made(spark, 3, [(0, 0), (0, 1), (0, 1), (7, 1)], kinds={1: "import", 2: "call"})
    assert {r["id"]: (r["fan_in"], r["fan_out"]) for r in degree.fan_metrics(nodes, edges).collect()} == {0: (1, 3), 1: (3, 0), 2: (0, 0)}
    g = {(r["src"], r["dst"]): (r["edge_count"], r["dominant_kind"]) for r in degree.edge_groups(edges).collect()}
    assert g[0, 1] == (2, "import")  # equals: the kind seen first


def test_empty_graph(spark):
    nodes, edges = made(spark, 1, [])
    nodes = nodes.limit(0)
    assert degree.fan_metrics(nodes, edges).count() == 0 and recursion.clusters(nodes, edges, nodes.select("id")).count() == 0
    assert recursion.strong_components(edges, False).count() == 0 and degree.edge_groups(edges).count() == 0
    found = report.findings(nodes, edges, nodes.select("id"))
    assert "## Overview" in report.markdown(found)


def test_subgraph_and_selection(spark):
    nodes, edges = made(spark, 4, [(0, 1), (1, 2), (2, 9)])
    n, e = filters.subgraph(nodes, edges, nodes.where("id < 2"))
    assert n.count() == 2 and e.count() == 1
    c = recursion.clusters(nodes, edges, nodes.limit(0).select("id"))
    with pytest.raises(ValueError):
        filters.selected_clusters(c, " nothing, ")
    assert filters.initial_scope(c).count() == 4


def test_confined(tmp_path):
    (tmp_path / "a.ts").write_text("x")
    assert filters.confined("a.ts", str(tmp_path)).endswith("a.ts")
    with pytest.raises(PermissionError):
        filters.confined("../secret", str(tmp_path))
