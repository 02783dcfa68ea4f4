"""Exact vector operators; blocked where all pairs are the question."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is whole: not null, of finite numbers, not all zero.
    Others are near nothing."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.col("v").isNotNull() & fine)


def _blocks(rows: DataFrame, block: int) -> int:
    """So many that each has ``block`` rows, about, whatever the table's size."""
    return max(1, -(-rows.count() // block))


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = 5000) -> DataFrame:
    """The ``k`` nearest rows (id, v) of each query by cosine, itself excluded,
    ties by id. Rows and queries are dealt to blocks of ``block``, about; a task
    multiplies one block of each, so none sees a whole side."""
    rows, queries = _usable(rows), _usable(queries)
    n_rows, n_queries = _blocks(rows, block), _blocks(queries, block)
    q = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_queries))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)).cast("array<long>")))
    r = rows.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(n_rows))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)).cast("array<long>")))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "other": [], "sim": []})
        a, b = np.stack(left["v"]).astype(float), np.stack(right["v"]).astype(float)
        a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
        sims, ids = np.round(a @ b.T, 9), right["id"].to_numpy()
        sims[left["id"].to_numpy()[:, None] == ids[None, :]] = -2
        order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
        return pd.DataFrame({"id": np.repeat(left["id"].to_numpy(), order.shape[1]), "other": ids[order].reshape(-1), "sim": np.take_along_axis(sims, order, 1).reshape(-1)}).query("sim > -2")

    near = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(meet, "id long, other long, sim double")
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "other")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def pairs_at_least(rows: DataFrame, least: float, block: int = 3000) -> DataFrame:
    """Pairs (id < other) of rows with a cosine of at least ``least``; every two
    blocks meet in one task, which gives the pairs found there only."""
    rows = _usable(rows)
    blocks = _blocks(rows, block)
    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    dealt = rows.withColumn("own", own).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).withColumn("lo", F.least("own", "x")).withColumn("hi", F.greatest("own", "x"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids, own = np.stack(pdf["v"]).astype(float), pdf["id"].to_numpy(), pdf["own"].to_numpy()
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        a, b = np.flatnonzero(own == pdf["lo"].iloc[0]), np.flatnonzero(own == pdf["hi"].iloc[0])
        sims = np.round(v[a] @ v[b].T, 9)
        i, j = np.nonzero(sims >= least)
        x, y, s = ids[a[i]], ids[b[j]], sims[i, j]
        keep = x < y if pdf["lo"].iloc[0] == pdf["hi"].iloc[0] else x != y
        return pd.DataFrame({"id": np.minimum(x, y)[keep], "other": np.maximum(x, y)[keep], "sim": s[keep]})

    return dealt.groupBy("lo", "hi").applyInPandas(meet, "id long, other long, sim double")


def centroids(rows: DataFrame) -> DataFrame:
    """cls and the mean of its vectors, component by component, in one pass of
    partial sums."""
    flat = rows.select("cls", F.posexplode("v").alias("i", "x"))
    mean = flat.groupBy("cls", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("c"))


def kmeans(rows: DataFrame, k: int, rounds: int = 8) -> DataFrame:
    """id, cluster: Lloyd rounds from evenly spread seeds by id. The centres
    (k rows) are the only thing that travels."""
    rows = _usable(rows)
    seeds = rows.withColumn("u", F.xxhash64("id")).orderBy("u").limit(k).select("v").collect()
    if not seeds:
        return rows.select("id", F.lit(0).alias("cluster"))
    centres = np.array([s.v for s in seeds], float)

    def sums(stream):
        for batch in stream:
            x = np.array(batch.column(0).to_pylist(), float)
            near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            for c in np.unique(near).tolist():
                yield pa.RecordBatch.from_pydict({"c": pa.array([c], pa.int32()), "n": [int((near == c).sum())], "s": [x[near == c].sum(axis=0).tolist()]})

    for _ in range(rounds):
        got = rows.select("v").mapInArrow(sums, "c int, n long, s array<double>").select("c", "n", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        new = centres.copy()
        for g in got:
            new[g.c, g.i] = g.x / g.n
        centres = new

    @F.pandas_udf("int")
    def cluster(v: pd.Series) -> pd.Series:
        x = np.stack(v).astype(float)
        return pd.Series(((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1))

    return rows.select("id", cluster("v").alias("cluster"))


def principal(rows: DataFrame, dims: int = 2, rounds: int = 40) -> DataFrame:
    """id, p: projections on the leading directions of the covariance, which is
    summed on the executors and decomposed by power iteration with deflation
    from a fixed start; signs are fixed by the start."""

    rows = _usable(rows)

    def moments(stream):
        for batch in stream:
            x = np.array(batch.column(0).to_pylist(), float)
            yield pa.RecordBatch.from_pydict({"n": [len(x)], "s": [x.sum(axis=0).tolist()], "m": [(x.T @ x).reshape(-1).tolist()]})

    parts = rows.select("v").mapInArrow(moments, "n long, s array<double>, m array<double>")
    n = parts.agg(F.sum("n")).first()[0]
    if not n:
        return rows.select("id", F.array().cast("array<double>").alias("p"))
    s = np.array([r.x for r in parts.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()])
    m = np.array([r.x for r in parts.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()]).reshape(len(s), len(s))
    cov = m / n - np.outer(s / n, s / n)
    axes = []
    for d in range(dims):
        x = np.cos(np.arange(len(s)) * (d + 1)) + 0.5
        for _ in range(rounds):
            x = cov @ x
            x /= np.linalg.norm(x)
        axes.append(x)
        cov = cov - (x @ cov @ x) * np.outer(x, x)
    turn, mean = np.array(axes).T, s / n

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v).astype(float) - mean) @ turn))

    return rows.select("id", project("v").alias("p"))
