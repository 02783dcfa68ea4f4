"""Further questions: mentions, records, links, reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlit.functions import stats as St
from lumenlit.functions import text as X
from lumenlit.operators import mentions as Me
from lumenlit.plans.documents import docs
from lumenlit.plans.registry import query


@query("W09 E03 E04", "", "WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents), h AS (SELECT doc_id, generate_subscripts(w, 1) AS i, w FROM w), f AS (SELECT doc_id, i, CASE WHEN w[i] = 'general' AND w[i+1] = 'public' AND w[i+2] = 'license' THEN 1 WHEN w[i] = 'apache' AND w[i+1] = 'license' THEN 2 WHEN w[i] = 'license' AND NOT (coalesce(w[i-1], '') = 'apache' OR coalesce(w[i-1], '') = 'public' AND coalesce(w[i-2], '') = 'general') THEN 3 END AS n FROM h) SELECT doc_id AS id, n::BIGINT AS name_id, count(*) AS hits, min(i)::BIGINT - 1 AS first FROM f WHERE n IS NOT NULL GROUP BY ALL")
def name_scan(b):
    """Longest match first, no overlaps."""
    return Me.scan_names(docs(b), {"general public license": 1, "apache license": 2, "license": 3})


@query("J06 E10 J05 A10", "", "WITH m AS (SELECT p_partkey AS mention_id, p_name AS key, p_brand || ' ' || p_type AS cites FROM part), c AS (SELECT p_name AS key, p_partkey AS id, p_brand || ' ' || p_type AS title FROM part WHERE p_partkey % 20 = 0), a AS (SELECT key, count(*) AS n, min(id) AS sole FROM c GROUP BY 1), h AS (SELECT mention_id, count(DISTINCT id) AS m, min(id) AS hit FROM m JOIN c USING (key) WHERE contains(cites, title) AND len(title) >= 12 GROUP BY 1) SELECT m.mention_id, CASE WHEN n = 1 THEN sole WHEN h.m = 1 THEN hit END AS id, CASE WHEN n IS NULL THEN 'unknown' WHEN n = 1 OR h.m = 1 THEN 'attributed' ELSE 'homonym' END AS outcome FROM m LEFT JOIN a ON a.key = m.key LEFT JOIN h ON h.mention_id = m.mention_id")
def homonyms(b):
    p = b.table("part")
    title = F.concat_ws(" ", "p_brand", "p_type")
    c = p.filter("p_partkey % 20 = 0")
    return Me.resolve_homonyms(p.select(F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("key"), title.alias("cites")), c.select(F.col("p_name").alias("key"), F.col("p_partkey").alias("id")), c.select(F.col("p_partkey").alias("id"), title.alias("title")))


@query("F17", "", "WITH v AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM documents) SELECT doc_id, count(*) AS terms FROM v WHERE contains(term, 'licen') GROUP BY 1")
def interned_substring(b):
    """A stem is looked for in the vocabulary, then texts by its terms."""
    t = docs(b).select(F.col("id").alias("doc_id"), F.explode(F.array_distinct(X.words(F.col("text")))).alias("term"))
    v = t.select("term").distinct().filter(F.col("term").contains("licen"))
    return t.join(v, "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("terms"))


@query("F23 F25 E12 W07", "", "WITH l AS (SELECT l_orderkey AS paper, l_partkey AS link, l_linenumber::BIGINT AS pos, l_quantity > 25 AND (l_shipdate >= TIMESTAMP '1997-01-01' OR l_returnflag = 'N') AS own FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY paper, own ORDER BY pos, link) AS rank FROM l) SELECT paper, link, pos, own FROM r WHERE rank <= CASE WHEN own THEN 4 ELSE 2 END")
def capped_links(b):
    """Own links and others, the first few of each for display."""
    own = (F.col("l_quantity") > 25) & ((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) | (F.col("l_returnflag") == "N"))
    l = b.table("lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("link"), F.col("l_linenumber").cast("long").alias("pos"), own.alias("own"))
    w = Window.partitionBy("paper", "own").orderBy("pos", "link")
    return l.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.when(F.col("own"), 4).otherwise(2)).drop("rank")


@query("F26", "", r"SELECT doc_id, len(list_filter(string_split(text || ' 博弈 x', ' '), lambda w: NOT regexp_matches(w, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]'))) AS plain FROM documents")
def script_drop(b):
    """Terms written in other scripts are dropped."""
    return b.documents().select("doc_id", F.size(F.filter(F.split(F.concat("text", F.lit(" 博弈 x")), " "), lambda w: ~w.rlike(X.OTHER_SCRIPTS))).cast("long").alias("plain"))


@query("X02 X06 X07 X08", "", "SELECT DISTINCT p_name, regexp_replace(translate(lower(p_name || ' É'), 'éèêàâçùûôîïöüä', 'eeeaacuuoiioua'), '[^a-z ]', '', 'g') AS person, CASE WHEN regexp_matches(p_name, '(ss|us|is)$') THEN p_name ELSE regexp_replace(p_name, 's$', '') END AS singular, coalesce(CASE split_part(p_name, ' ', 1) WHEN 'small' THEN 'little' WHEN 'large' THEN 'big' END, split_part(p_name, ' ', 1)) AS alias FROM part")
def name_variants(b):
    n = F.col("p_name")
    alias = F.create_map(F.lit("small"), F.lit("little"), F.lit("large"), F.lit("big"))
    first = F.split_part(n, F.lit(" "), F.lit(1))
    return b.table("part").select(n, F.regexp_replace(F.translate(F.lower(F.concat(n, F.lit(" É"))), "éèêàâçùûôîïöüä", "eeeaacuuoiioua"), "[^a-z ]", "").alias("person"), F.when(n.rlike("(ss|us|is)$"), n).otherwise(F.regexp_replace(n, "s$", "")).alias("singular"), F.coalesce(F.element_at(alias, first), first).alias("alias")).distinct()


@query("X12", "", "SELECT doc_id, CASE WHEN instr(text, 'License') > 0 THEN substr(text, greatest(instr(text, 'License') - 40, 1), 80) END AS around FROM documents WHERE contains(text, 'License')")
def windows_around(b):
    at = F.instr("text", "License")
    return b.documents().filter(F.col("text").contains("License")).select("doc_id", F.when(at > 0, F.substring("text", F.greatest(at - 40, F.lit(1)), F.lit(80))).alias("around"))


@query("D01 D06", "obs", "SELECT paper_id, obs_id, min(obs_id) OVER (PARTITION BY paper_id, edition) AS representative FROM obs")
def representatives(b):
    """Rows of one paper and edition resolve to the smallest of them."""
    o = b.observations()
    rep = o.groupBy("paper_id", "edition").agg(F.min("obs_id").alias("representative"))
    return o.join(rep, ["paper_id", "edition"]).select("paper_id", "obs_id", "representative")


@query("D02 D44 J16", "", "SELECT c_custkey AS id, c_name AS title, n_name AS area, coalesce(k, 0) AS cited FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def paper_records(b):
    k = b.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    j = b.table("customer").join(b.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(k, "c_custkey", "left")
    return j.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("n_name").alias("area"), F.coalesce("k", F.lit(0)).alias("cited"))


@query("D03 E17 E18", "", "SELECT doc_id, substr(text, 1, 280) AS card, coalesce(nullif(split_part(text, '.', 2), ''), split_part(text, '.', 1)) AS change FROM documents")
def cards(b):
    t = F.col("text")
    return b.documents().select("doc_id", F.substring(t, 1, 280).alias("card"), F.coalesce(F.nullif(F.split_part(t, F.lit("."), F.lit(2)), F.lit("")), F.split_part(t, F.lit("."), F.lit(1))).alias("change"))


@query("D10 E21 E16", "obs claims bench", "SELECT id, name, claim_year, claim_edition, contains(brand, '1') AS in_title FROM bench LEFT JOIN claims ON benchmark_id = id")
def claim_rows(b):
    return b.benchmarks().join(b.claims(), F.col("id") == F.col("benchmark_id"), "left").select("id", "name", "claim_year", "claim_edition", F.col("brand").contains("1").alias("in_title"))


@query("D12", "", "WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 6 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 8 <> 0), r AS (SELECT doc_id, quality FROM labels) SELECT r.doc_id, CASE WHEN n.h IS NULL THEN CASE WHEN quality = 1 THEN 'retain' ELSE 'retire' END WHEN o.h IS NULL THEN 'pending' WHEN o.h <> n.h THEN 'stale' ELSE 'applied' END AS outcome FROM r LEFT JOIN o USING (doc_id) LEFT JOIN n USING (doc_id)")
def review_outcomes(b):
    """Reviews whose evidence is gone, new, changed or the same."""
    d = b.documents()
    o = d.filter("doc_id % 2 = 0").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h0"))
    n = d.filter("doc_id % 8 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")).alias("h1"))
    r = b.table("labels").select("doc_id", "quality").join(o, "doc_id", "left").join(n, "doc_id", "left")
    return r.select("doc_id", F.when(F.col("h1").isNull(), F.when(F.col("quality") == 1, "retain").otherwise("retire")).when(F.col("h0").isNull(), "pending").when(F.col("h0") != F.col("h1"), "stale").otherwise("applied").alias("outcome"))


@query("D22 D31 E23", "", "SELECT doc_id, sha256(text) AS version, 'archive/' || substr(sha256(text), 1, 2) || '/' || sha256(text) AS path FROM documents")
def archive_paths(b):
    h = F.sha2("text", 256)
    return b.documents().select("doc_id", h.alias("version"), F.concat(F.lit("archive/"), F.substring(h, 1, 2), F.lit("/"), h).alias("path"))


@query("D25 S20", "", "SELECT s_suppkey AS id, n_name AS host, 'h' || n_nationkey || ':' || (s_suppkey % 10) AS key, count(*) OVER (PARTITION BY n_nationkey, s_suppkey % 10) AS shared FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def repo_keys(b):
    s = b.table("supplier").join(b.table("nation"), F.col("n_nationkey") == F.col("s_nationkey")).withColumn("key", F.concat(F.lit("h"), "n_nationkey", F.lit(":"), F.col("s_suppkey") % 10))
    n = s.groupBy("key").agg(F.count("*").alias("shared"))
    return s.join(n, "key").select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("host"), "key", "shared")


@query("D39 D41", "labels", "SELECT paper_id, bool_or(origin = 'derived_topic') AND NOT bool_or(label = 'BUILDING') AS narrower FROM olabels GROUP BY 1")
def narrower_badge(b):
    return b.labels().groupBy("paper_id").agg((F.bool_or(F.col("origin") == "derived_topic") & ~F.bool_or(F.col("label") == "BUILDING")).alias("narrower"))


@query("D43 E13", "", "SELECT i.item_id, count(*) AS verified FROM benchmark i JOIN documents d ON contains(' ' || trim(regexp_replace(lower(coalesce(d.source, '') || ' ' || d.text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(i.text), '[^a-z0-9]+', ' ', 'g')) || ' ') WHERE len(trim(regexp_replace(lower(i.text), '[^a-z0-9]+', ' ', 'g'))) >= 20 GROUP BY 1")
def verified_quotes(b):
    """Quotes that stand in the joined source fields of a text."""
    from lumenlit.operators.match import contained_passages

    d = b.documents().select(F.col("doc_id").alias("id"), F.concat_ws(" ", "source", "text").alias("text"))
    hits = contained_passages(b.table("benchmark").select(F.col("item_id").alias("id"), "text"), d)
    return hits.groupBy(F.col("passage_id").alias("item_id")).agg(F.count("*").alias("verified"))


@query("V04 D38", "", "WITH q AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) WHERE vec_id % 7 = 0 AND label = 3 GROUP BY ALL), c AS (SELECT list(m ORDER BY i) AS c FROM q), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], c) AS s FROM embeddings, c) SELECT vec_id, round(s, 6) AS s FROM s ORDER BY s DESC, vec_id LIMIT 20")
def semantic_extras(b):
    """The texts nearest to the centroid of a set of hits."""
    from lumenlit.operators.vectors import centroids

    e = b.table("embeddings").select("vec_id", F.col("embedding").alias("v"), F.col("label").alias("cls"))
    c = centroids(e.filter("vec_id % 7 = 0 and cls = 3")).select("c")
    s = e.crossJoin(F.broadcast(c)).select("vec_id", St.cosine(F.col("v"), F.col("c")).alias("s"))  # one centroid
    return s.orderBy(F.desc("s"), "vec_id").limit(20).select("vec_id", F.round("s", 6).alias("s"))


@query("J11", "", "WITH c AS (SELECT c_custkey AS id, c_nationkey AS n, c_custkey % 10 AS k, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 10 ORDER BY c_custkey) AS i FROM customer), s AS (SELECT s_suppkey AS id, s_nationkey AS n, s_suppkey % 10 AS k, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 10 ORDER BY s_suppkey) AS i FROM supplier) SELECT c.id AS a, s.id AS b FROM c JOIN s ON c.n = s.n AND c.k = s.k AND c.i = s.i")
def author_pairs(b):
    """One-to-one pairs of equal names within a nation, the first with the first."""
    def placed(t, i, n):
        k = (F.col(i) % 10).alias("k")
        return t.select(F.col(i).alias("id"), F.col(n).alias("n"), k).withColumn("i", F.row_number().over(Window.partitionBy("n", "k").orderBy("id")))

    c, s = placed(b.table("customer"), "c_custkey", "c_nationkey"), placed(b.table("supplier"), "s_suppkey", "s_nationkey")
    return c.withColumnRenamed("id", "a").join(s.withColumnRenamed("id", "b"), ["n", "k", "i"]).select("a", "b")


@query("N02", "", "SELECT event_type, count(*) AS facts, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def tool_facts(b):
    """Numbers of nested results, flattened through the variant type."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return b.table("events").groupBy("event_type").agg(F.count("*").alias("facts"), F.sum(k).alias("total"))


@query("T09 D26", "obs", "SELECT edition, sum(obs_id)::BIGINT % 1000003 AS state, count(*) AS rows FROM obs GROUP BY 1")
def input_states(b):
    """A state per edition that changes when its rows do."""
    return b.observations().groupBy("edition").agg((F.sum("obs_id") % 1000003).alias("state"), F.count("*").alias("rows"))
