"""Set, window, order and join questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlit.functions import text as X
from lumenlit.operators.rank import ranked
from lumenlit.plans.registry import query
from lumenlit.sources import files as Fi


@query("U01 D06", "", "WITH u AS (SELECT 'a' AS corpus, p_partkey AS eid FROM part WHERE p_size <= 10 UNION ALL SELECT 'b', s_suppkey FROM supplier) SELECT corpus, eid, row_number() OVER (ORDER BY corpus, eid) - 1 AS gid FROM u")
def global_ids(b):
    """Ids over two corpora by key."""
    u = b.table("part").filter("p_size <= 10").select(F.lit("a").alias("corpus"), F.col("p_partkey").alias("eid")).unionByName(b.table("supplier").select(F.lit("b").alias("corpus"), F.col("s_suppkey").alias("eid")))
    return ranked(u, [F.col("corpus"), F.col("eid")]).select("corpus", "eid", (F.col("rank") - 1).alias("gid"))


@query("U02 U04", "obs uses", "SELECT obs_id FROM uses WHERE surface >= 60 INTERSECT SELECT obs_id FROM uses WHERE role = 'trains_on' EXCEPT SELECT obs_id FROM obs WHERE venue = 'low'")
def set_algebra(b):
    u = b.uses()
    return u.filter("surface >= 60").select("obs_id").intersect(u.filter("role = 'trains_on'").select("obs_id")).subtract(b.observations().filter("venue = 'low'").select("obs_id"))


@query("U06 U07 J17 D36", "obs uses", "s AS (SELECT obs_id, list_sort(list(DISTINCT benchmark_id)) AS s FROM uses GROUP BY 1), f AS (SELECT obs_id, unnest(s) AS e FROM s), c AS (SELECT DISTINCT x.obs_id AS a, y.obs_id AS b FROM f x JOIN f y ON x.e = y.e AND x.obs_id < y.obs_id) SELECT c.a, c.b, len(list_intersect(p.s, q.s)) AS shared, round(len(list_intersect(p.s, q.s))::DOUBLE / len(list_distinct(list_concat(p.s, q.s))), 6) AS jaccard FROM c JOIN s p ON p.obs_id = c.a JOIN s q ON q.obs_id = c.b")
def shared_sets(b):
    """Pairs of observations that use the same entries, joined on the entry."""
    u = b.uses().select("obs_id", "benchmark_id").distinct()
    n = u.groupBy("obs_id").agg(F.count("*").alias("n"))
    j = u.select(F.col("obs_id").alias("a"), "benchmark_id").join(u.select(F.col("obs_id").alias("b"), "benchmark_id"), "benchmark_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    j = j.join(n.select(F.col("obs_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("obs_id").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


@query("F14 F15 F16 D35 D40", "obs labels uses", "t AS (SELECT o.obs_id, o.edition, list(label) AS l FROM obs o JOIN olabels USING (paper_id) GROUP BY ALL) SELECT edition, count(*) AS n FROM t WHERE list_has_any(l, ['BUILDING', 'FURNITURE']) AND list_has_any(l, ['ASIA', 'EUROPE']) GROUP BY 1")
def facets(b):
    """Or within a facet, and across facets."""
    l = b.labels().groupBy("paper_id").agg(F.collect_set("label").alias("l"))
    o = b.observations().join(l, "paper_id")
    some = lambda *x: F.arrays_overlap("l", F.array(*map(F.lit, x)))
    return o.filter(some("BUILDING", "FURNITURE") & some("ASIA", "EUROPE")).groupBy("edition").agg(F.count("*").alias("n"))


@query("F15 D40", "obs labels", "f AS (SELECT paper_id, bool_or(label IN ('BUILDING')) AS a, bool_or(label IN ('ASIA')) AS g FROM olabels GROUP BY 1) SELECT label, count(DISTINCT obs_id) FILTER (origin = 'declared_area' AND g OR origin = 'derived_topic' AND a) AS n FROM obs JOIN f USING (paper_id) JOIN olabels USING (paper_id) WHERE origin <> 'declared_subarea' GROUP BY 1")
def chip_counts(b):
    """Counts of each chip under all filters but its own facet's."""
    f = b.labels().groupBy("paper_id").agg(F.bool_or(F.col("label") == "BUILDING").alias("a"), F.bool_or(F.col("label") == "ASIA").alias("g"))
    j = b.observations().join(f, "paper_id").join(b.labels().filter("origin <> 'declared_subarea'"), "paper_id")
    ok = ((F.col("origin") == "declared_area") & F.col("g")) | ((F.col("origin") == "derived_topic") & F.col("a"))
    return j.groupBy("label").agg(F.count_distinct(F.when(ok, F.col("obs_id"))).alias("n"))


@query("F18 A38 D37", "", "SELECT p_brand AS corpus, bit_or(1 << (p_size % 5)::INT)::BIGINT AS bits, count(*) FILTER (p_size & 1 > 0) AS code, count(*) FILTER (p_size & 16 > 0) AS full_text, count(*) AS papers FROM part GROUP BY 1")
def resource_bits(b):
    p = b.table("part")
    return p.groupBy(F.col("p_brand").alias("corpus")).agg(F.bit_or(F.expr("shiftleft(1L, p_size % 5)")).alias("bits"), F.count_if(F.expr("p_size & 1 > 0")).alias("code"), F.count_if(F.expr("p_size & 16 > 0")).alias("full_text"), F.count("*").alias("papers"))


@query("F19", "", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 2500 AND c_nationkey BETWEEN 3 AND 9")
def map_box(b):
    return b.table("customer").filter(F.col("c_acctbal").between(0, 2500) & F.col("c_nationkey").between(3, 9)).select("c_custkey")


@query("F20 F21", "", "SELECT DISTINCT p_name AS name, regexp_matches(p_name, '^[a-z]+ [a-z]{4,}$') AND NOT regexp_matches(p_name, '^(other|misc|general)') AS accepted FROM part")
def name_shapes(b):
    n = F.col("p_name")
    return b.table("part").select(n.alias("name"), (n.rlike("^[a-z]+ [a-z]{4,}$") & ~n.rlike("^(other|misc|general)")).alias("accepted")).distinct()


@query("F27 F28", "", "SELECT o_custkey, o_orderkey FROM (SELECT *, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS visible FROM orders) WHERE NOT visible OR o_orderstatus = 'F'")
def visible_rows(b):
    """Visible rows of a group, or all of them if none is visible."""
    o = b.table("orders")
    some = o.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("some"))
    return o.join(some, "o_custkey").filter("not some or o_orderstatus = 'F'").select("o_custkey", "o_orderkey")


@query("K02", "", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page(b):
    return b.table("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


@query("K06", "", "SELECT id, rank FROM (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END NULLS LAST, c_custkey) AS rank FROM customer) WHERE rank <= 5")
def named_first(b):
    key = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    w = Window.partitionBy("c_nationkey").orderBy(key.asc_nulls_last(), "c_custkey")
    return b.table("customer").select(F.col("c_custkey").alias("id"), F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 5")


@query("K07", "", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('s' || l_orderkey || '-' || l_linenumber), l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 25")
def stratified_sample(b):
    """A seeded sample: the smallest hashes of each stratum."""
    h = F.md5(F.concat(F.lit("s"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).cast("binary"))
    w = Window.partitionBy("l_returnflag").orderBy(h, "l_orderkey", "l_linenumber")
    return b.table("lineitem").withColumn("r", F.row_number().over(w)).filter("r <= 25").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("J04 W14", "obs", "SELECT paper_id, (min((year, obs_id)))[2] AS obs_id FROM obs GROUP BY 1")
def bridge(b):
    """The first event of each paper."""
    return b.observations().groupBy("paper_id").agg(F.min_by("obs_id", F.struct("year", "obs_id")).alias("obs_id"))


@query("J23 S21 T04", "", "SELECT c_custkey FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS seen FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE seen IS NULL OR date_diff('day', seen, TIMESTAMP '2001-01-01 00:00:00') > 60")
def stale_cache(b):
    """What has no fetch or one that is older than 60 days."""
    o = b.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("at"))
    return b.table("customer").join(o, "c_custkey", "left").filter(F.col("at").isNull() | (F.datediff(F.lit("2001-01-01").cast("date"), F.col("at").cast("date")) > 60)).select("c_custkey")


@query("J22 S31 T06", "", "WITH o AS (SELECT p_partkey AS id, p_size AS v FROM part WHERE p_partkey % 3 > 0), n AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 5 > 0) SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'vanished' WHEN o.v = n.v THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.id = n.id")
def claim_history(b):
    p = b.table("part")
    o = p.filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    n = p.filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("w"))
    state = F.when(F.col("v").isNull(), "new").when(F.col("w").isNull(), "vanished").when(F.col("v") == F.col("w"), "same").otherwise("changed")
    return o.join(n, "id", "full").select("id", state.alias("state"))


@query("S31", "", "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'new' ELSE p_brand END AS brand FROM part")
def replaced_rows(b):
    p = b.table("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return Fi.replace_rows(p, p.filter("id % 7 = 0").withColumn("brand", F.lit("new")), "id")


@query("S09 S06", "obs uses", "SELECT o.obs_id, count(u.obs_id) AS n_uses, sum(n_evidence)::BIGINT AS n_evidence FROM obs o LEFT JOIN uses u ON u.obs_id = o.obs_id WHERE year = 1996 GROUP BY 1")
def nested_records(b):
    r = Fi.nest(b.observations().filter("year = 1996"), b.uses())
    return r.select("obs_id", F.when(F.col("uses").isNull(), 0).otherwise(F.size("uses")).cast("long").alias("n_uses"), F.aggregate("uses", F.lit(0).cast("long"), lambda a, x: a + x.n_evidence).alias("n_evidence"))


@query("S16 S28", "", "SELECT p_partkey AS id, ('0x' || substr(sha1(p_name || p_brand), 1, 8))::BIGINT AS stable, sha256(p_name) AS content FROM part")
def stable_ids(b):
    return b.table("part").select(F.col("p_partkey").alias("id"), X.stable_id(F.concat("p_name", "p_brand")).alias("stable"), F.sha2("p_name", 256).alias("content"))


@query("S26 X21", "", "WITH k AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), '[^a-z]', '', 'g') || p_size AS base, p_name, p_size, p_brand FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS r FROM k) SELECT id, '@inproceedings{' || base || repeat('a', (r - 1)::INT) || ', author = {' || p_name || '}, year = {' || p_size || '}, title = {' || regexp_replace(p_brand, '([&%$#_])', '\\\\\\1', 'g') || '}}' AS bibtex FROM r")
def bibtex_export(b):
    return Fi.bibtex_lines(b.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("author"), F.col("p_size").alias("year"), F.col("p_brand").alias("title")))


@query("A17 A10", "obs uses bench", "p AS (SELECT id, name, first_value(name) OVER (PARTITION BY split_part(name, ' ', 1) ORDER BY id) AS lead FROM bench) SELECT o.venue, count(DISTINCT o.obs_id) AS papers FROM uses u JOIN p ON p.id = u.benchmark_id JOIN obs o ON o.obs_id = u.obs_id WHERE starts_with(name, 'small') GROUP BY 1")
def benchmark_info(b):
    some = b.benchmarks().filter(F.col("name").startswith("small")).select(F.col("id").alias("benchmark_id"))
    return b.uses().join(some, "benchmark_id", "left_semi").join(b.observations(), "obs_id").groupBy("venue").agg(F.count_distinct("obs_id").alias("papers"))


@query("A40 V15", "obs uses bench labels", "c AS (SELECT label AS f, brand AS t, count(*) AS c FROM uses u JOIN obs o USING (obs_id) JOIN olabels l USING (paper_id) JOIN bench ON id = benchmark_id WHERE origin = 'declared_area' GROUP BY ALL), d AS (SELECT t, count(*) AS df FROM c WHERE c > 5 GROUP BY 1), w AS (SELECT f, t, c * ln(1 + 5.0 / df) AS w FROM c JOIN d USING (t)), n AS (SELECT f, t, w / sqrt(sum(w * w) OVER (PARTITION BY f)) AS x FROM w) SELECT a.f AS a, b.f AS b, round(sum(a.x * b.x), 6) AS sim FROM n a JOIN n b ON a.t = b.t AND a.f < b.f GROUP BY ALL")
def field_profiles(b):
    """Cosine of the normalised technique profiles of fields."""
    l = b.labels().filter("origin = 'declared_area'").select("paper_id", F.col("label").alias("f"))
    c = b.uses().join(b.observations(), "obs_id").join(l, "paper_id").join(b.benchmarks(), F.col("id") == F.col("benchmark_id")).groupBy("f", F.col("brand").alias("t")).agg(F.count("*").alias("c"))
    d = c.filter("c > 5").groupBy("t").agg(F.count("*").alias("df"))
    w = c.join(d, "t").withColumn("w", F.col("c") * F.log1p(5.0 / F.col("df")))
    n = w.withColumn("x", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("f"))))
    a, z = n.select(F.col("f").alias("a"), "t", "x"), n.select(F.col("f").alias("b"), "t", F.col("x").alias("y"))
    return a.join(z, "t").filter("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("sim"))


@query("A41 K08", "", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean FROM events GROUP BY CUBE (event_type)")
def outcomes(b):
    return b.table("events").cube("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean"))


@query("X09 X10 X22", "", "SELECT DISTINCT p_type AS track, lower(regexp_extract(p_type, '^(\\w+)', 1)) AS field, CASE WHEN contains(p_type, 'ECONOMY') THEN 'workshop' WHEN contains(p_type, 'PROMO') THEN 'demo' ELSE 'main' END AS kind FROM part")
def tracks(b):
    t = F.col("p_type")
    return b.table("part").select(t.alias("track"), F.lower(F.regexp_extract(t, r"^(\w+)", 1)).alias("field"), F.when(t.contains("ECONOMY"), "workshop").when(t.contains("PROMO"), "demo").otherwise("main").alias("kind")).distinct()


@query("N08 S01", "", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k') IS NOT NULL")
def event_props(b):
    return b.table("events").select("event_id", F.from_json("props", "k long").k.alias("k")).filter("k is not null")


@query("D18 U09", "obs uses bench", "r AS (SELECT obs_id, brand, min(benchmark_id) AS first FROM uses JOIN bench ON id = benchmark_id GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY first) AS rank FROM r) SELECT obs_id, string_agg(brand, ';' ORDER BY first) AS names FROM k WHERE rank <= 2 GROUP BY 1")
def card_names(b):
    """The first two distinct names of an observation."""
    r = b.uses().join(b.benchmarks(), F.col("id") == F.col("benchmark_id")).groupBy("obs_id").agg(F.array_sort(F.collect_set(F.struct("benchmark_id", "brand"))).alias("x"))
    return r.select("obs_id", F.array_join(F.slice(F.array_distinct(F.transform("x", lambda s: s.brand)), 1, 2), ";").alias("names"))


@query("E22 D08", "labels", "SELECT paper_id, string_agg(label, '|' ORDER BY origin) AS labels, count(*) AS n FROM olabels GROUP BY 1")
def paper_labels(b):
    return b.labels().groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("origin", "label"))).alias("x")).select("paper_id", F.array_join(F.transform("x", lambda s: s.label), "|").alias("labels"), F.size("x").cast("long").alias("n"))


@query("A09", "obs uses", "SELECT benchmark_id, count(DISTINCT paper_id) AS papers, count(DISTINCT paper_id) FILTER (role = 'trains_on') AS training FROM uses JOIN obs USING (obs_id) WHERE benchmark_id IN (3, 5, 7, 11, 13) GROUP BY 1")
def adoption_list(b):
    u = b.uses().filter(F.col("benchmark_id").isin(3, 5, 7, 11, 13)).join(b.observations(), "obs_id")
    return u.groupBy("benchmark_id").agg(F.count_distinct("paper_id").alias("papers"), F.count_distinct(F.when(F.col("role") == "trains_on", F.col("paper_id"))).alias("training"))


@query("A01 U09", "obs uses", "c AS (SELECT year, benchmark_id, count(DISTINCT obs_id) AS n FROM uses JOIN obs USING (obs_id) GROUP BY 1, 2), r AS (SELECT year, benchmark_id, n, row_number() OVER (PARTITION BY year ORDER BY n DESC, benchmark_id) AS rank FROM c) SELECT * FROM r WHERE rank <= 3")
def yearly_top(b):
    c = b.uses().join(b.observations(), "obs_id").groupBy("year", "benchmark_id").agg(F.count_distinct("obs_id").alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("n"), "benchmark_id")).cast("long")).filter("rank <= 3")
