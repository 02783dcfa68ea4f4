"""Empty cells of fields and techniques: six scorers, tested on what later
editions filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Papers that make a field and a technique (fixed values).
LEAST_FIELD, LEAST_TECHNIQUE = 12, 8
SCORERS = ("random", "pa", "cf", "lim", "lim_cf", "lim_spec")


def world(rows: DataFrame, least_field: int = LEAST_FIELD, least_technique: int = LEAST_TECHNIQUE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (paper, field, techniques): fields (f, nf), techniques (t, nt)
    and observed cells (f, t, n). A technique counts in all papers, a cell in
    those with a field."""
    fields = rows.filter("field is not null").groupBy(F.col("field").alias("f")).agg(F.count("*").alias("nf")).filter(F.col("nf") >= least_field)
    used = rows.select("paper", F.col("field").alias("f"), F.explode(F.array_distinct("techniques")).alias("t"))
    techniques = used.groupBy("t").agg(F.count("*").alias("nt")).filter(F.col("nt") >= least_technique)
    cells = used.join(fields.select("f"), "f", "left_semi").join(techniques.select("t"), "t", "left_semi").groupBy("f", "t").agg(F.count("*").alias("n"))
    return fields, techniques, cells


def empty_cells(fields: DataFrame, techniques: DataFrame, cells: DataFrame) -> DataFrame:
    """f, nf, t, nt of every pair that no paper has joined: the question is
    fields times techniques, two short lists."""
    return fields.join(techniques, F.lit(True)).join(cells.select("f", "t"), ["f", "t"], "left_anti")


def _neighbours(cells: DataFrame, own: str, other: str) -> DataFrame:
    """a, b, jac: pairs of one side that share something of the other."""
    sizes = cells.groupBy(own).agg(F.count("*").alias("k"))
    x, y = cells.select(F.col(own).alias("a"), other), cells.select(F.col(own).alias("b"), other)
    both = x.join(y, other).filter("a != b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = both.join(sizes.select(F.col(own).alias("a"), F.col("k").alias("ka")), "a").join(sizes.select(F.col(own).alias("b"), F.col("k").alias("kb")), "b")
    return both.select("a", "b", (F.col("shared") / (F.col("ka") + F.col("kb") - F.col("shared"))).alias("jac"))


def collaborative(empty: DataFrame, cells: DataFrame) -> DataFrame:
    """f, t, cf: how alike the fields that use the technique are to this field,
    and the field's techniques to this one."""
    ff, tt = _neighbours(cells, "f", "t"), _neighbours(cells, "t", "f")
    by_field = cells.join(ff.withColumnRenamed("b", "f"), "f").groupBy(F.col("a").alias("f"), "t").agg(F.sum("jac").alias("x"))
    by_technique = cells.join(tt.withColumnRenamed("b", "t"), "t").groupBy("f", F.col("a").alias("t")).agg(F.sum("jac").alias("y"))
    j = empty.select("f", "t").join(by_field, ["f", "t"], "left").join(by_technique, ["f", "t"], "left")
    return j.select("f", "t", (F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))).alias("cf"))


def limitation_match(rows: DataFrame, empty: DataFrame, fields: DataFrame, techniques: DataFrame, low: int = 3, high: float = 0.02) -> DataFrame:
    """f, t, lim: the cosine of the terms in which a field states what fails and
    those in which a technique's papers state what it brings. ``rows`` also has
    limits and claims, arrays of terms (null: none stated)."""
    rows = rows.filter("field is not null")
    n = rows.agg(F.count("*").alias("n"))
    every = rows.select(F.explode(F.array_distinct(F.concat(F.coalesce("limits", F.array().cast("array<string>")), F.coalesce("claims", F.array().cast("array<string>"))))).alias("w"))
    band = every.groupBy("w").agg(F.count("*").alias("c")).join(n, F.lit(True)).filter((F.col("c") >= low) & (F.col("c") <= F.col("n") * high))
    idf = band.select("w", F.ln(F.col("n") / F.col("c")).alias("idf"))

    def vectors(stated: DataFrame, key: str) -> DataFrame:
        size = stated.groupBy(key).agg(F.count("*").alias("k"))
        terms = stated.select(key, F.explode(F.array_distinct("terms")).alias("w")).groupBy(key, "w").agg(F.count("*").alias("c"))
        v = terms.join(idf, "w").join(size, key).select(key, "w", (F.col("c") / F.col("k") * F.col("idf")).alias("v"))
        norm = v.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        return v.join(norm, key).select(key, "w", F.try_divide("v", "norm").alias("v"))

    failing = rows.filter("size(limits) > 0").select(F.col("field").alias("f"), F.col("limits").alias("terms")).join(fields.select("f"), "f", "left_semi")
    bringing = rows.filter("size(claims) > 0").select(F.explode(F.array_distinct("techniques")).alias("t"), F.col("claims").alias("terms")).join(techniques.select("t"), "t", "left_semi")
    dot = vectors(failing, "f").join(vectors(bringing, "t").withColumnRenamed("v", "u"), "w").groupBy("f", "t").agg(F.sum(F.col("v") * F.col("u")).alias("lim"))
    return empty.select("f", "t").join(dot, ["f", "t"], "left").withColumn("lim", F.coalesce("lim", F.lit(0.0)))


def score_cells(rows: DataFrame, least_field: int = LEAST_FIELD, least_technique: int = LEAST_TECHNIQUE, seed: str = "cells", high: float = 0.02) -> DataFrame:
    """f, t and the six scores of every empty cell."""
    fields, techniques, cells = world(rows, least_field, least_technique)
    empty = empty_cells(fields, techniques, cells)
    spread = cells.groupBy("t").agg(F.count("*").alias("fields"))
    s = empty.join(collaborative(empty, cells), ["f", "t"]).join(limitation_match(rows, empty, fields, techniques, high=high), ["f", "t"]).join(spread, "t", "left")
    bounds = s.agg(F.min("lim").alias("l0"), F.max("lim").alias("l1"), F.min("cf").alias("c0"), F.max("cf").alias("c1"))

    def unit(x: str, lo: str, hi: str) -> Column:
        return F.when(F.col(hi) > F.col(lo), (F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0)

    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "f", "t")), 1, 12), 16, 10).cast("double")
    return s.join(bounds, F.lit(True)).select("f", "t", drawn.alias("random"), (F.col("nf") * F.col("nt")).cast("double").alias("pa"), "cf", "lim", (unit("lim", "l0", "l1") * unit("cf", "c0", "c1")).alias("lim_cf"), (F.col("lim") / F.ln(2 + F.coalesce("fields", F.lit(0)))).alias("lim_spec"))


def validate(scores: DataFrame, later: DataFrame, at: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """One row for each scorer: cells, filled (in ``later``: f, t), precision at
    each of ``at`` and average precision; ties go by field and technique."""
    truth = later.select("f", "t").distinct().withColumn("hit", F.lit(1))
    flat = scores.join(truth, ["f", "t"], "left").select("f", "t", F.coalesce("hit", F.lit(0)).alias("hit"), F.inline(F.array(*[F.struct(F.lit(s).alias("scorer"), F.round(F.col(s), 9).alias("score")) for s in SCORERS])))
    order = Window.partitionBy("scorer").orderBy(F.desc("score"), "f", "t")
    ranked = flat.withColumn("rank", F.row_number().over(order)).withColumn("hits", F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = F.sum("hit")
    return ranked.groupBy("scorer").agg(
        F.count("*").alias("cells"),
        found.cast("long").alias("filled"),
        *[F.round(F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)) / k, 3).alias(f"p{k}") for k in at],
        F.round(F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)) / F.greatest(F.lit(1), found), 4).alias("average_precision"),
    )
