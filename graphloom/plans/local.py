"""Solvers for small graphs: one task reads the whole edge list. Chosen by a checked size only; larger graphs take the distributed loops."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a graph is solved in one task.
SMALL = 200_000


def is_small(*frames: DataFrame, most: int = SMALL) -> bool:
    """Whether the frames have `most` rows in all; reads no more rows than that."""
    left = most
    for f in frames:
        left -= f.limit(left + 1).count()
        if left < 0:
            return False
    return True


def solve(frames: dict[str, DataFrame], function: Callable[[dict[str, list[tuple]]], list[tuple]], schema: str) -> DataFrame:
    """Runs function on the rows of the frames, each of two columns u, v of one type, in one task."""
    rows = None
    for tag, f in frames.items():
        tagged = f.select(F.lit(tag).alias("tag"), *f.columns[:2]).toDF("tag", "u", "v")
        rows = tagged if rows is None else rows.unionAll(tagged)

    tags = list(frames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, list[tuple]] = {t: [] for t in tags}
        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(1).type
            for t, u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                read[t].append((u, v))
        out = function(read)
        names = [x.split()[0] for x in schema.split(", ")]
        types = [kind if x.split()[0] in ("node", "root") else pa.int64() for x in schema.split(", ")]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return rows.coalesce(1).mapInArrow(run, schema)


def reach(read: dict[str, list[tuple]]) -> list[tuple]:
    after = defaultdict(list)
    for u, v in read["edges"]:
        after[u].append(v)
    seen = {u for u, _ in read["seeds"]}
    queue = deque(seen)
    while queue:
        for v in after[queue.popleft()]:
            if v not in seen:
                seen.add(v)
                queue.append(v)
    return [(x,) for x in seen]


def components(read: dict[str, list[tuple]]) -> list[tuple]:
    """(node, least node of its component), of nodes with an edge to another."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in read["edges"]:
        a, b = find(u), find(v)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root)]


def strong(read: dict[str, list[tuple]]) -> list[tuple]:
    """(node, least node of its strong component), of components with two nodes at least: two sweeps, the second against the edges."""
    after, before = defaultdict(set), defaultdict(set)
    for u, v in read["edges"]:
        after[u].add(v)
        before[v].add(u)
    finished, seen = [], set()
    for s in [*after, *before]:
        if s in seen:
            continue
        seen.add(s)
        trail = [(s, iter(after[s] if s in after else ()))]
        while trail:
            for v in trail[-1][1]:
                if v not in seen:
                    seen.add(v)
                    trail.append((v, iter(after[v] if v in after else ())))
                    break
            else:
                finished.append(trail.pop()[0])
    out, taken = [], set()
    for s in reversed(finished):
        if s in taken:
            continue
        group, todo = [], [s]
        taken.add(s)
        while todo:
            x = todo.pop()
            group.append(x)
            for v in before[x] if x in before else ():
                if v not in taken:
                    taken.add(v)
                    todo.append(v)
        if len(group) > 1:
            least = min(group)
            out += [(x, least) for x in group]
    return out


def layered(read: dict[str, list[tuple]]) -> list[tuple]:
    """(node, layer or -1 inside or behind a cycle) of the nodes of distinct edges: longest paths by removing sources."""
    after, waiting = defaultdict(list), defaultdict(int)
    nodes = {u for u, _ in read["nodes"]}
    for u, v in set(read["edges"]):
        after[u].append(v)
        waiting[v] += 1
    layer = dict.fromkeys((x for x in nodes if not waiting[x]), 0)
    queue = deque(layer)
    while queue:
        u = queue.popleft()
        for v in after[u]:
            layer[v] = max(layer.get(v, 0), layer[u] + 1)
            waiting[v] -= 1
            if not waiting[v]:
                queue.append(v)
    return [(x, layer[x] if x in layer and not waiting[x] else -1) for x in nodes]
