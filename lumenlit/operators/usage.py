"""Counts of benchmark use: usage, trend, adoption, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.functions.stats import per_1000, percentage, trend_state, two_proportion_z


def usage(scope: DataFrame, uses: DataFrame, role: str | None = None, limit: int = 100) -> DataFrame:
    """Observations in scope that use each entry, with exact shares of all
    observations in scope; the ``limit`` most used, ties by id."""
    limit = max(1, min(limit, 100))
    some = uses.filter((F.col("role") == role) & (F.col("n_evidence") > 0)) if role else uses
    counts = some.join(scope.select("obs_id"), "obs_id", "left_semi").groupBy("benchmark_id").agg(F.count_distinct("obs_id").alias("papers"))
    total = scope.agg(F.count("*").alias("parsed_papers"))
    rows = counts.crossJoin(F.broadcast(total))  # one row
    return rows.select("benchmark_id", "papers", "parsed_papers", percentage(F.col("papers"), F.col("parsed_papers")).alias("share_percent"), per_1000(F.col("papers"), F.col("parsed_papers")).alias("per_1000")).orderBy(F.desc("papers"), "benchmark_id").limit(limit)


def usage_samples(scope: DataFrame, uses: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` observations in scope of each entry."""
    w = Window.partitionBy("benchmark_id").orderBy("obs_id")
    rows = uses.select("obs_id", "benchmark_id").distinct().join(scope.select("obs_id", "paper_id"), "obs_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def trend(scope: DataFrame, uses: DataFrame, benchmark_id: int | None = None) -> DataFrame:
    """Uses per edition with observed zeros, and each edition against the one
    before it at its venue. Without an id, for every entry that is used."""
    sizes = scope.groupBy("venue", "edition").agg(F.count("*").alias("n"))
    some = uses if benchmark_id is None else uses.filter(F.col("benchmark_id") == benchmark_id)
    hits = some.select("obs_id", "benchmark_id").distinct().join(scope.select("obs_id", "edition"), "obs_id").groupBy("benchmark_id", "edition").agg(F.count("*").alias("k"))
    entries = hits.select("benchmark_id").distinct()
    grid = entries.join(sizes, F.lit(True))  # the question: every entry at every edition
    rows = grid.join(hits, ["benchmark_id", "edition"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    w = Window.partitionBy("benchmark_id", "venue").orderBy("edition")
    rows = rows.withColumn("k0", F.lag("k").over(w)).withColumn("n0", F.lag("n").over(w))
    k0, n0, k, n = (F.col(c) for c in ("k0", "n0", "k", "n"))
    return rows.select("benchmark_id", "venue", "edition", "k", "n", percentage(k, n).alias("share_percent"), F.round(two_proportion_z(k0, n0, k, n), 4).alias("z"), F.when(n0.isNotNull(), trend_state(k0, n0, k, n)).alias("state"))


def first_observations(scope: DataFrame) -> DataFrame:
    """The first observation of each paper, by year, edition and id."""
    first = scope.groupBy("paper_id").agg(F.min(F.struct("year", "edition", "obs_id")).alias("f"))
    return first.select("paper_id", "f.*")


def adoption(scope: DataFrame, uses: DataFrame, groups: DataFrame, claims: DataFrame) -> DataFrame:
    """Papers by entry and role: whether their authors are its developers
    (``groups``: benchmark_id, paper_id, who), and how many used it in years
    before its claim. Roles are merged over the observations of a paper."""
    used = uses.join(scope.select("obs_id", "paper_id"), "obs_id").groupBy("benchmark_id", "paper_id").agg(*[F.max((F.col("role") == r).cast("int")).alias(r) for r in ("evaluates_on", "trains_on")])
    rows = used.join(first_observations(scope).select("paper_id", "year"), "paper_id").join(groups, ["benchmark_id", "paper_id"], "left").join(claims.select("benchmark_id", "claim_year"), "benchmark_id")
    who = F.coalesce("who", F.lit("undetermined"))
    counts = [F.sum(((who == g) & (F.col(r) == 1)).cast("long")).alias(f"{r}_{g}") for r in ("evaluates_on", "trains_on") for g in ("others", "self", "undetermined")]
    return rows.groupBy("benchmark_id").agg(*counts, F.sum((F.col("year") < F.col("claim_year")).cast("long")).alias("before_claim"))


def null_poisoned_total(column: str):
    """A sum that is unknown as soon as one part is."""
    return F.when(F.count(column) == F.count("*"), F.sum(column))
