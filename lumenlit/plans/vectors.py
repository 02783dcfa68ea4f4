"""Questions over vectors and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlit.functions import stats as St
from lumenlit.operators import graph as G
from lumenlit.operators import vectors as V
from lumenlit.operators.rank import ranked
from lumenlit.plans.registry import query

SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _rows(b):
    return b.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("cls"))


@query("V06 V05 K04 D29", "", f"WITH s AS (SELECT a.vec_id AS id, b.vec_id AS other, round({SIM}, 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM s) SELECT id, other, round(sim, 6) AS sim, rank FROM k WHERE rank <= 5")
def nearest_vectors(b):
    """The five nearest of a stated set of queries (every fiftieth id)."""
    r = _rows(b).select("id", "v")
    return V.nearest(r, r.filter("id % 50 = 0"), 5).withColumn("sim", F.round("sim", 6))


@query("J19 V13", "", f"SELECT a.vec_id AS a, b.vec_id AS b, round({SIM}, 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE {SIM} >= 0.4")
def cross_pairs(b):
    """Similar vectors of different classes, block by block."""
    r = _rows(b)
    cls = r.select("id", "cls")
    near = V.pairs_at_least(r.select("id", "v"), 0.4)
    j = near.join(cls, "id").join(cls.select(F.col("id").alias("other"), F.col("cls").alias("c2")), "other").filter("cls <> c2")
    return j.select(F.col("id").alias("a"), F.col("other").alias("b"), F.round("sim", 6).alias("sim"))


@query("V12 M06 W12", "", "WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1), s AS (SELECT label, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings JOIN c USING (label)) SELECT label AS cls, round(quantile_cont(s, 0.7), 6) AS bar, round(avg(s), 6) AS mean FROM s GROUP BY 1")
def centroid_bars(b):
    """The 70th percentile of each class's similarities to its centroid."""
    r = _rows(b)
    s = r.join(V.centroids(r), "cls").select("cls", St.cosine(F.col("v"), F.col("c")).alias("s"))
    return s.groupBy("cls").agg(F.round(F.percentile("s", 0.7), 6).alias("bar"), F.round(F.avg("s"), 6).alias("mean"))


@query("M06 M07", "", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, greatest(0, least(255, round(abs(embedding[1]::DOUBLE) * 255)))::BIGINT AS q FROM embeddings")
def vector_norms(b):
    return _rows(b).select(F.col("id").alias("vec_id"), F.round(St.length_of(F.col("v")), 6).alias("norm"), St.quantise_unit(F.abs(F.col("v")[0].cast("double"))).cast("long").alias("q"))


@query("V09 V11")
def vector_clusters(b):
    return V.kmeans(_rows(b).select("id", "v"), 6).groupBy("cluster").agg(F.count("*").alias("n"))


@query("V07 V08")
def vector_map(b):
    p = V.principal(_rows(b).select("id", "v"))
    return p.select("id", F.round(F.col("p")[0], 5).alias("x"), F.round(F.col("p")[1], 5).alias("y"))


EDGES = "e AS (SELECT DISTINCT o_custkey AS a, l_suppkey + 1000000 AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 50 AND l_discount >= 0.09)"


def _edges(b):
    li = b.table("lineitem").filter("l_quantity >= 50 and l_discount >= 0.09")
    return li.join(b.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).distinct()


@query("G01 V13", "", f"WITH RECURSIVE {EDGES}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1")
def connected_components(b):
    return G.connected(_edges(b))


@query("G09 J18", "", f"WITH {EDGES}, o AS (SELECT a AS node, count(*) AS cites FROM e GROUP BY 1), i AS (SELECT b AS node, count(*) AS cited_by FROM e GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, coalesce(cites, 0) AS cites, coalesce(cited_by, 0) AS cited_by FROM o FULL JOIN i ON o.node = i.node")
def citation_degrees(b):
    return G.degrees(_edges(b))


@query("G10 A34", "", f"WITH {EDGES}, k AS (SELECT b FROM e GROUP BY 1 HAVING count(*) >= 2) SELECT a, b FROM e WHERE b IN (SELECT b FROM k)")
def shared_citations(b):
    e = _edges(b)
    return e.join(e.groupBy("b").agg(F.count("*").alias("n")).filter("n >= 2").select("b"), "b", "left_semi").select("a", "b")


@query("G06", "", "WITH x AS (SELECT c_name AS name, c_nationkey AS nation, c_custkey % 700 AS base, c_custkey AS id FROM customer) SELECT a.id, b.id AS other FROM x a JOIN x b ON a.base = b.base AND a.id < b.id AND a.nation <> b.nation")
def collisions(b):
    """Rows that claim one key but share no author."""
    x = b.table("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 700).alias("base"), F.array("c_nationkey").alias("authors"))
    y = x.select(F.col("id").alias("other"), "base", F.col("authors").alias("more"))
    return x.join(y, "base").filter((F.col("id") < F.col("other")) & ~F.arrays_overlap("authors", "more")).select("id", "other")


@query("G03", "", "SELECT p_name AS name, min(p_partkey) AS id, count(*) AS rows, min(p_brand) AS brand, max(CASE WHEN p_size > 45 THEN 1 ELSE 0 END) = 1 AS oral, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS kinds FROM part GROUP BY 1")
def merge_duplicates(b):
    return b.table("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("rows"), F.min("p_brand").alias("brand"), F.bool_or(F.col("p_size") > 45).alias("oral"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("kinds"))


@query("G07 J21", "obs", "d AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS wanted, p_type FROM part) SELECT d.id, CASE WHEN wanted IS NULL THEN 'stale' WHEN o.paper_id IS NULL THEN 'unmatched' WHEN o.n > 20 THEN 'conflict' ELSE 'applied' END AS outcome FROM d LEFT JOIN (SELECT paper_id, count(*) AS n FROM obs GROUP BY 1) o ON o.paper_id = d.id")
def apply_decisions(b):
    """Reviewed links: applied, stale, conflicting or without a row."""
    d = b.table("part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("wanted"))
    o = b.observations().groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("n"))
    return d.join(o, "id", "left").select("id", F.when(F.col("wanted").isNull(), "stale").when(F.col("n").isNull(), "unmatched").when(F.col("n") > 20, "conflict").otherwise("applied").alias("outcome"))


@query("W10 W11", "", "WITH s AS (SELECT p_partkey AS id, p_retailprice AS score, p_size > 25 AS hit FROM part), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s) SELECT id, rank, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS scaled, round(sum(hit::INT) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING)::DOUBLE / rank, 6) AS precision FROM r")
def ranked_precision(b):
    """Scores from 0 to 1 and precision at each rank."""
    s = b.table("part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), (F.col("p_size") > 25).cast("int").alias("hit"))
    ends = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    r = ranked(s, [F.desc("score"), F.col("id")], "hit").join(F.broadcast(ends), F.lit(True))  # one row
    return r.select("id", "rank", F.round((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("scaled"), F.round(F.col("total") / F.col("rank"), 6).alias("precision"))
