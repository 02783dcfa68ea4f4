"""Connected components of an edge table of any size, kept on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.llm.caches import tidy
from lumenlit.llm.store import discard, materialise

#: Nodes of a larger degree than others are joined by a broadcast of at most so many.
_HUBS = 50_000
#: Edges that are contracted at once, and that one task ends with (16 bytes each).
_AT_ONCE = 1_000_000


def reached(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, sorted, and the smallest node each reaches."""
    nodes, place = np.unique(np.concatenate((x, y)), return_inverse=True)
    a, b, up = place[: len(x)], place[len(x) :], np.arange(len(nodes))
    while True:
        p, q = up[a], up[b]
        apart = p != q
        if not apart.any():
            return nodes, nodes[up]
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while ((higher := up[up]) != up).any():
            up = higher


def _contracted(pairs: DataFrame, at_once: int) -> DataFrame:
    """Edges u > v with the same components, in each task at most one for each
    node of so many edges."""

    def run(stream):
        held, count, ended = [], 0, False
        while not ended:
            batch = next(stream, None)
            ended = batch is None
            if not ended and len(batch):
                held.append([c.to_numpy() for c in batch.columns])
                count += len(batch)
            if held and (ended or count >= at_once):
                u, v = reached(*(np.concatenate(c) for c in zip(*held)))
                held, count, own = [], 0, u != v
                yield pa.RecordBatch.from_arrays([pa.array(u[own]), pa.array(v[own])], names=["u", "v"])

    return pairs.mapInArrow(tidy(run), "u long, v long")


def _in_one(edges: DataFrame) -> DataFrame:
    """node, component of few edges, by one task."""

    def run(stream):
        batches = [[c.to_numpy() for c in batch.columns] for batch in stream if len(batch)]
        if batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in reached(*(np.concatenate(c) for c in zip(*batches)))], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(tidy(run), "node long, component long")


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _tied(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """``edges`` with the m of their u; ``least`` has u, m and n, the edges of
    u. Nodes with many edges are broadcast, so that no task gets all of one:
    those over ``rows / _HUBS`` edges are at most ``_HUBS``."""
    many = max(1000, rows // _HUBS)
    least = materialise(least, "least")
    hubs = F.broadcast(least.filter(F.col("n") > many).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= many).select("u", "m"), "u")
    return edges.join(hubs, "u").union(rest)


def components(edges: DataFrame, a: str, b: str, at_once: int = _AT_ONCE) -> DataFrame:
    """node, component: the smallest node that each node of an edge reaches.

    Numbers are contracted where their edges lie, and if no more than
    ``at_once`` edges are left, one task ends them. Else, and for other nodes,
    alternates two rewrites that keep the components: every larger neighbour of
    a node is tied to the smallest of its neighbourhood, then every smaller
    one. Neighbourhoods are only reduced to their minimum, never gathered, and
    each round is written to the shared folder. Ends when nothing changes,
    after a number of rounds in the order of the logarithm of the diameter.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x != y")
    if [kind for _, kind in pairs.dtypes] == ["bigint"] * 2:
        held = materialise(_contracted(pairs, at_once), "contracted")
        if held.count() <= at_once:
            out = materialise(_in_one(held), "components")
            discard(held)
            return out
        now = materialise(held.distinct(), "edges")
        discard(held)
    else:
        now = materialise(pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    before = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = materialise(_tied(both, least, 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = _tied(large, low, before[0])
        small = joined.filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, materialise(small, "edges")
        after = _state(now)
        discard(last, large)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def forest(n: int, left, right) -> list[int]:
    """The smallest place that each of n places reaches by these pairs."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(left, right):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def grouped(stream, keys: list[str]):
    """Runs of equal keys in a sorted Arrow stream, as lists of columns."""
    at, held = None, None
    for batch in stream:
        data = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        for row, key in enumerate(zip(*(data[k] for k in keys))):
            if key != at:
                if held is not None:
                    yield at, held
                at, held = key, {name: [] for name in data}
            for name, column in data.items():
                held[name].append(column[row])
    if held is not None:
        yield at, held
