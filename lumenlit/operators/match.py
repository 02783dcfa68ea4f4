"""Matching of titles, names and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlit.functions.text import norm, padded, title_tokens


def exact_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (id, title) of the left with the smallest right id of an equal
    normalised title."""
    index = right.select(norm(F.col("title")).alias("key"), F.col("id").alias("match_id")).groupBy("key").agg(F.min("match_id").alias("match_id"))
    return left.withColumn("key", norm(F.col("title"))).join(index, "key").select("id", "match_id")


def _token_sets(rows: DataFrame) -> DataFrame:
    """id, and its tokens as a sorted text: equal sets are equal texts."""
    return rows.select("id", F.array_join(F.array_sort(title_tokens(F.col("title"))), " ").alias("key")).filter("key != ''")


def fuzzy_titles(left: DataFrame, right: DataFrame, threshold: float = 0.85, margin: float = 0.05) -> DataFrame:
    """Best title by token Jaccard. A runner-up within the margin makes a match
    ambiguous.

    Titles of one token set are compared once. Two sets at the threshold share
    one of the rarest tokens of each, and their sizes are near: only prefixes
    are joined, as keys of a token and a size, and sets travel as ids.
    """
    own, other = _token_sets(left), _token_sets(right)
    sets = other.groupBy("key").agg(F.min("id").alias("r"), F.count("*").alias("n"))
    both = own.select("key", F.lit(0).alias("side")).distinct().union(sets.select("key", F.lit(1)))
    flat = both.select("key", "side", F.explode(F.split("key", " ")).alias("w"), F.size(F.split("key", " ")).alias("size"))
    df = flat.groupBy("w").agg(F.count("*").alias("df"))
    order = Window.partitionBy("side", "key").orderBy("df", "w")
    prefix = flat.join(df, "w").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1)
    sizes = F.sequence(F.ceil(F.col("size") * threshold - 1e-9).cast("int"), F.floor(F.col("size") / threshold + 1e-9).cast("int"))
    a = prefix.filter("side = 0").select(F.col("key").alias("l"), "w", F.explode(sizes).alias("size"))
    b = prefix.filter("side = 1").select(F.col("key").alias("rk"), "w", "size")
    x, y = F.split("l", " "), F.split("rk", " ")
    shared = F.size(F.array_intersect(x, y))
    score = a.join(b, ["w", "size"]).select("l", "rk").distinct().select("l", "rk", (shared / (F.size(x) + F.size(y) - shared)).alias("score")).filter(F.col("score") >= threshold)
    w = Window.partitionBy("l").orderBy(F.desc("score"), "r")
    ranked = score.join(sets.withColumnRenamed("key", "rk"), "rk").withColumn("rank", F.row_number().over(w)).withColumn("next", F.when(F.col("n") > 1, F.col("score")).otherwise(F.lead("score").over(w))).filter("rank = 1")
    kind = F.when(F.col("next").isNotNull() & (F.col("score") - F.col("next") < margin), "ambiguous").when(F.col("score") == 1, "exact").otherwise("fuzzy")
    best = ranked.select(F.col("l").alias("key"), F.when(kind != "ambiguous", F.col("r")).alias("match_id"), F.round("score", 6).alias("score"), kind.alias("kind"))
    return own.join(best, "key").select("id", "match_id", "score", "kind")


def best_overlap(left: DataFrame, right: DataFrame, most: int = 200, top: int = 3) -> DataFrame:
    """Of the ``most`` titles that share the most tokens with each title, the
    ``top`` by Jaccard: id, other, shared, jaccard, rank; ties by id. Equal token
    sets are compared once."""
    own, other = _token_sets(left), _token_sets(right)
    explode = lambda rows, name: rows.select(F.col("key").alias(name), F.explode(F.split("key", " ")).alias("w"))
    sets = other.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids"))  # no more than ``most`` of a set can be asked for
    shared = explode(own.select("key").distinct(), "l").join(explode(sets.select("key"), "rk"), "w").groupBy("l", "rk").agg(F.count("*").alias("shared"))
    some = shared.withColumn("k", F.rank().over(Window.partitionBy("l").orderBy(F.desc("shared")))).filter(F.col("k") <= most)
    rows = some.join(sets.withColumnRenamed("key", "rk"), "rk").select("l", "shared", (F.col("shared") / (F.size(F.split("l", " ")) + F.size(F.split("rk", " ")) - F.col("shared"))).alias("jaccard"), F.explode("ids").alias("other"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("shared"), "other"))).filter(F.col("k") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("jaccard"), "other")).cast("long")).filter(F.col("rank") <= top)
    return own.join(ranked.withColumnRenamed("l", "key"), "key").select("id", "other", "shared", F.round("jaccard", 6).alias("jaccard"), "rank")


def contained_passages(passages: DataFrame, texts: DataFrame, least: int = 20) -> DataFrame:
    """Pairs (passage id, text id) where the normalised passage stands in the
    normalised text at word ends.

    Both meet on the passage's rarest word. Texts are normalised once; where the
    passages' words are few they go with the tasks, and a text's words are kept
    only where one of them is an anchor, so the join is on a key and containment
    is tested for few pairs.
    """
    p = passages.select(F.col("id").alias("p"), padded(F.col("text")).alias("pt")).filter(F.length("pt") >= least + 2)
    t = texts.select(F.col("id").alias("t"), padded(F.col("text")).alias("tt"))
    cut = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    words = p.select("p", F.explode(cut("pt")).alias("w"))
    wanted = words.select("w").distinct()
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("w")), F.lit(0))).first()
    hint = F.broadcast if n <= 100_000 and size <= 2_000_000 else lambda x: x
    df = t.select(F.explode(cut("tt")).alias("w")).join(hint(wanted), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    anchors = words.join(df, "w", "left").groupBy("p").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w")).alias("a")).select("p", F.col("a.w").alias("w"))
    hits = t.select("t", "tt", F.explode(cut("tt")).alias("w")).join(hint(anchors.join(p, "p")), "w")
    return hits.filter(F.col("tt").contains(F.col("pt"))).select(F.col("p").alias("passage_id"), F.col("t").alias("text_id"))
