"""Benchmark-usage questions: scope, usage, trend, new, adoption, evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlit.functions.stats import p_value, percentage, trend_state, two_proportion_z
from lumenlit.functions.text import fold
from lumenlit.operators import usage as U
from lumenlit.operators.scope import Scope, find_entity, latest_editions
from lumenlit.plans.registry import query

PCT = "CASE WHEN {n} > 0 THEN (floor(({k})::HUGEINT * 2000 / ({n}) + 1)::HUGEINT // 2) / 10.0::DOUBLE END"
Z = "CASE WHEN n0 > 0 AND n > 0 THEN CASE WHEN k0 + k = 0 OR k0 + k = n0 + n THEN 0.0 ELSE (k::DOUBLE / n - k0::DOUBLE / n0) / sqrt(((k0 + k)::DOUBLE / (n0 + n)) * (1 - (k0 + k)::DOUBLE / (n0 + n)) * (1.0 / n0 + 1.0 / n)) END END"
FOLD = "regexp_replace(regexp_replace(regexp_replace(trim(replace(replace(replace(replace(lower({x}), 'τ', 'tau'), '∞', 'infinity'), '²', '2'), '³', '3')), '^(the|a)\\s+', ''), '[\\s\\-_]+(benchmark|dataset|corpus|suite|benchmarks|datasets|suites)$', ''), '[^a-z0-9+]', '', 'g')"


def usage_sql(where: str = "", limit: int = 100) -> str:
    return f"""n AS (SELECT count(*) AS n FROM scope), c AS (SELECT benchmark_id, count(DISTINCT u.obs_id) AS papers FROM uses u JOIN scope s ON s.obs_id = u.obs_id {where} GROUP BY 1)
SELECT benchmark_id, papers, n AS parsed_papers, {PCT.format(k='papers', n='n')} AS share_percent, round(papers::DOUBLE / n * 1000, 3) AS per_1000 FROM c, n ORDER BY papers DESC, benchmark_id LIMIT {limit}"""


@query("A01 F03 A02 K01 M01 M02 W03", "obs uses latest", usage_sql())
def usage(b):
    """Use in the latest edition of every venue."""
    return U.usage(Scope(latest=True).apply(b.observations()), b.uses())


@query("A01 F08 F01 F02", "obs uses", "scope AS (SELECT * FROM obs WHERE venue = 'urgent' AND year IN (1996, 1997)), " + usage_sql("WHERE role = 'trains_on'", 20))
def usage_trains_on(b):
    return U.usage(Scope(venue="URGENT", years=[1996, 1997]).apply(b.observations()), b.uses(), "trains_on", 20)


@query("A01 F05 J01 J07", "obs uses labels", "scope AS (SELECT * FROM obs WHERE year = 1997 AND paper_id IN (SELECT paper_id FROM olabels WHERE lower(label) = 'building')), " + usage_sql(limit=50))
def usage_in_topic(b):
    return U.usage(Scope(topic="Building", years=[1997]).apply(b.observations(), b.labels()), b.uses(), limit=50)


@query("F06 F07", "obs", "SELECT obs.* FROM obs WHERE paper_id IN (SELECT unnest([]::BIGINT[]))")
def scope_empty_list(b):
    """An empty list of papers selects nothing."""
    return Scope(papers=[]).apply(b.observations())


@query("F06 J01", "obs", "SELECT * FROM obs WHERE paper_id IN (1, 2, 3, 5, 8, 13, 21)")
def scope_papers(b):
    return Scope(papers=[1, 2, 3, 5, 8, 13, 21]).apply(b.observations())


@query("F03 W03 F02", "obs latest", "SELECT venue, edition, count(*) AS n FROM scope GROUP BY ALL")
def latest_scope(b):
    return latest_editions(b.observations()).groupBy("venue", "edition").agg(F.count("*").alias("n"))


@query("F02 F04", "obs", "SELECT * FROM obs WHERE edition = 'high-1998'")
def scope_edition(b):
    return Scope(edition="HIGH-1998").checked(b.observations())


@query("A01 K01", "obs uses latest", "r AS (SELECT u.benchmark_id, s.obs_id, s.paper_id, row_number() OVER (PARTITION BY benchmark_id ORDER BY s.obs_id) AS rank FROM (SELECT DISTINCT obs_id, benchmark_id FROM uses) u JOIN scope s ON s.obs_id = u.obs_id) SELECT * FROM r WHERE rank <= 2")
def usage_samples(b):
    return U.usage_samples(latest_editions(b.observations()), b.uses()).select("benchmark_id", "obs_id", "paper_id", "rank")


@query("A02", "obs uses labels", "f AS (SELECT DISTINCT paper_id FROM olabels WHERE label <> 'MACHINERY' AND origin = 'declared_area'), x AS (SELECT DISTINCT obs_id FROM uses WHERE role = 'trains_on') SELECT edition, count(*) AS parsed_papers, count(f.paper_id) AS field_labelled_papers, count(x.obs_id) AS training_papers FROM obs o LEFT JOIN f ON f.paper_id = o.paper_id LEFT JOIN x ON x.obs_id = o.obs_id GROUP BY edition")
def denominators(b):
    f = b.labels().filter("label <> 'MACHINERY' and origin = 'declared_area'").select("paper_id", F.lit(1).alias("f")).distinct()
    x = b.uses().filter("role = 'trains_on'").select("obs_id", F.lit(1).alias("x")).distinct()
    return b.observations().join(f, "paper_id", "left").join(x, "obs_id", "left").groupBy("edition").agg(F.count("*").alias("parsed_papers"), F.count("f").alias("field_labelled_papers"), F.count("x").alias("training_papers"))


@query("A03", "obs", "e AS (SELECT venue, edition, CASE WHEN year = 1995 AND venue = 'low' THEN NULL ELSE count(*) END AS total FROM obs GROUP BY venue, edition, year) SELECT venue, CASE WHEN count(total) = count(*) THEN sum(total)::BIGINT END AS total FROM e GROUP BY venue")
def edition_totals(b):
    """A venue's total is unknown as soon as one edition's is."""
    e = b.observations().groupBy("venue", "edition", "year").agg(F.count("*").alias("n")).withColumn("total", F.when(~((F.col("year") == 1995) & (F.col("venue") == "low")), F.col("n")))
    return e.groupBy("venue").agg(U.null_poisoned_total("total").alias("total"))


@query("A04 K01", "obs labels", "SELECT lower(label) AS label, count(DISTINCT obs_id) AS papers FROM obs JOIN olabels USING (paper_id) GROUP BY 1 ORDER BY papers DESC, label LIMIT 100")
def field_counts(b):
    return b.observations().join(b.labels(), "paper_id").groupBy(F.lower("label").alias("label")).agg(F.count_distinct("obs_id").alias("papers")).orderBy(F.desc("papers"), "label").limit(100)


@query("A05", "obs labels", "SELECT origin, lower(label) AS label, count(DISTINCT obs_id) AS papers FROM obs JOIN olabels USING (paper_id) GROUP BY GROUPING SETS ((origin), (origin, lower(label)))")
def label_origins(b):
    j = b.observations().join(b.labels(), "paper_id").select("obs_id", "origin", F.lower("label").alias("label"))
    return j.groupingSets([["origin"], ["origin", "label"]], "origin", "label").agg(F.count_distinct("obs_id").alias("papers"))


@query("F13", "labels", "SELECT DISTINCT label FROM olabels WHERE contains(lower(label), 'an')")
def field_search(b):
    return b.labels().filter(F.lower("label").contains("an")).select("label").distinct()


TREND = f"""sizes AS (SELECT venue, edition, count(*) AS n FROM obs GROUP BY ALL), hits AS (SELECT benchmark_id, edition, count(DISTINCT u.obs_id) AS k FROM uses u JOIN obs o ON o.obs_id = u.obs_id GROUP BY ALL),
grid AS (SELECT e.benchmark_id, s.venue, s.edition, coalesce(h.k, 0) AS k, s.n FROM (SELECT DISTINCT benchmark_id FROM hits) e CROSS JOIN sizes s LEFT JOIN hits h ON h.benchmark_id = e.benchmark_id AND h.edition = s.edition),
t AS (SELECT *, lag(k) OVER w AS k0, lag(n) OVER w AS n0 FROM grid WINDOW w AS (PARTITION BY benchmark_id, venue ORDER BY edition)),
z AS (SELECT *, {Z} AS z FROM t)
SELECT benchmark_id, venue, edition, k, n, {PCT.format(k='k', n='n')} AS share_percent, round(z, 4) AS z, CASE WHEN n0 IS NULL THEN NULL WHEN k0 = 0 AND k >= 8 THEN 'appearing' WHEN z >= 2.576 THEN 'rising' WHEN z <= -2.576 THEN 'falling' ELSE 'no_detected_change' END AS state FROM z"""


@query("A06 W01 M03 M01", "obs uses", TREND + " WHERE benchmark_id = 7")
def trend_one(b):
    return U.trend(b.observations(), b.uses(), 7)


@query("A06 W01 A30", "obs uses", TREND)
def trend_all(b):
    return U.trend(b.observations(), b.uses())


@query("A07 W05 U06 F08", "obs uses claims", """who AS (SELECT l_partkey AS benchmark_id, o.paper_id, CASE WHEN bool_or(c_acctbal < 0) THEN 'undetermined' WHEN bool_or(c_nationkey = s_nationkey) THEN 'self' ELSE 'others' END AS who FROM lineitem JOIN obs o ON o.obs_id = l_orderkey JOIN customer ON c_custkey = o.paper_id JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
used AS (SELECT benchmark_id, paper_id, bool_or(role = 'evaluates_on') AS e, bool_or(role = 'trains_on') AS t FROM uses u JOIN obs o ON o.obs_id = u.obs_id GROUP BY ALL),
f AS (SELECT paper_id, min(year) AS year FROM obs GROUP BY 1)
SELECT u.benchmark_id, count(*) FILTER (e AND who = 'others') AS evaluates_on_others, count(*) FILTER (e AND who = 'self') AS evaluates_on_self, count(*) FILTER (e AND who = 'undetermined') AS evaluates_on_undetermined, count(*) FILTER (t AND who = 'others') AS trains_on_others, count(*) FILTER (t AND who = 'self') AS trains_on_self, count(*) FILTER (t AND who = 'undetermined') AS trains_on_undetermined, count(*) FILTER (f.year < claim_year) AS before_claim
FROM used u JOIN who w ON w.benchmark_id = u.benchmark_id AND w.paper_id = u.paper_id JOIN f ON f.paper_id = u.paper_id JOIN claims c ON c.benchmark_id = u.benchmark_id GROUP BY 1""")
def adoption(b):
    li = b.table("lineitem").select(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("benchmark_id"), "l_suppkey")
    who = li.join(b.observations().select("obs_id", "paper_id"), "obs_id").join(b.table("customer").select(F.col("c_custkey").alias("paper_id"), "c_nationkey", "c_acctbal"), "paper_id").join(b.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    groups = who.groupBy("benchmark_id", "paper_id").agg(F.when(F.bool_or(F.col("c_acctbal") < 0), "undetermined").when(F.bool_or(F.col("c_nationkey") == F.col("s_nationkey")), "self").otherwise("others").alias("who"))
    return U.adoption(b.observations(), b.uses(), groups, b.claims())


@query("W05", "obs", "SELECT paper_id, (min((year, edition, obs_id)))[1] AS year, (min((year, edition, obs_id)))[2] AS edition, (min((year, edition, obs_id)))[3] AS obs_id FROM obs GROUP BY 1")
def first_observations(b):
    return U.first_observations(b.observations())


@query("A08 J03 U02", "obs uses bench", "homonym AS (SELECT name FROM bench GROUP BY name HAVING count(*) > 1), cand AS (SELECT id, name FROM bench JOIN homonym USING (name)) SELECT c.name, count(DISTINCT o.paper_id) AS papers FROM uses u JOIN cand c ON c.id = u.benchmark_id JOIN obs o ON o.obs_id = u.obs_id GROUP BY 1")
def unattributed_papers(b):
    """Papers that name an entry whose name others share."""
    e = b.benchmarks().select("id", "name")
    shared = e.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    cand = e.join(shared, "name")
    return b.uses().join(cand, F.col("benchmark_id") == F.col("id")).join(b.observations(), "obs_id").groupBy("name").agg(F.count_distinct("paper_id").alias("papers"))


@query("J05 X01 U05 U09", "bench", f"k AS (SELECT id, {FOLD.format(x='name')} AS key FROM bench) SELECT a.id, count(*) - 1 AS homonyms, min(b.id) AS first_id FROM k a JOIN k b ON a.key = b.key GROUP BY 1")
def homonym_candidates(b):
    k = b.benchmarks().select("id", fold(F.col("name")).alias("key"))
    per = k.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return k.join(per, "key").select("id", (F.col("n") - 1).alias("homonyms"), "first_id")


@query("F09 X01 J16", "bench", "SELECT id, name, kind, brand FROM bench WHERE id = 42")
def entity_by_id(b):
    return find_entity(b.benchmarks(), fold, "42")


@query("F10 F11 A09 K02 K03", "obs uses bench claims", "a AS (SELECT benchmark_id, count(DISTINCT paper_id) AS papers FROM uses JOIN obs USING (obs_id) GROUP BY 1) SELECT id, name, claim_year, claim_edition, papers FROM bench JOIN claims c ON c.benchmark_id = id JOIN a ON a.benchmark_id = id WHERE kind = 'benchmark' AND claim_year >= 1996 ORDER BY claim_year DESC, id LIMIT 25 OFFSET 10")
def new_benchmarks(b):
    """Introductions of a kind, newest first, a page of them."""
    a = b.uses().join(b.observations(), "obs_id").groupBy("benchmark_id").agg(F.count_distinct("paper_id").alias("papers"))
    e = b.benchmarks().filter("kind = 'benchmark'").join(b.claims(), F.col("id") == F.col("benchmark_id")).drop("benchmark_id")
    return e.join(a, F.col("id") == F.col("benchmark_id")).filter("claim_year >= 1996").orderBy(F.desc("claim_year"), "id").offset(10).limit(25).select("id", "name", "claim_year", "claim_edition", "papers")


@query("F12 J21", "obs bench claims labels", "i AS (SELECT DISTINCT l_partkey AS benchmark_id FROM lineitem JOIN obs o ON o.obs_id = l_orderkey JOIN olabels USING (paper_id) WHERE l_returnflag = 'N' AND label = 'ASIA') SELECT id, name FROM bench WHERE kind = 'dataset' AND id IN (SELECT benchmark_id FROM i)")
def introduced_in_field(b):
    li = b.table("lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("id"))
    field = b.labels().filter("label = 'ASIA'").select("paper_id")
    inside = b.observations().join(field, "paper_id", "left_semi").select("obs_id")
    return b.benchmarks().filter("kind = 'dataset'").join(li.join(inside, "obs_id", "left_semi").select("id"), "id", "left_semi").select("id", "name")


@query("J21", "obs bench claims", "SELECT id, name FROM bench WHERE id NOT IN (SELECT benchmark_id FROM claims)")
def never_introduced(b):
    return b.benchmarks().join(b.claims(), F.col("id") == F.col("benchmark_id"), "left_anti").select("id", "name")


@query("J02 K02 W06", "obs evidence", "r AS (SELECT e.*, o.edition, row_number() OVER (PARTITION BY e.obs_id, benchmark_id, role ORDER BY ord, place) AS rank FROM evidence e JOIN obs o ON o.obs_id = e.obs_id) SELECT obs_id, benchmark_id, role, ord, place, edition, rank FROM r WHERE rank <= 2")
def evidence_rows(b):
    """At most two passages for each observation, entry and role, by their order
    and place."""
    w = Window.partitionBy("obs_id", "benchmark_id", "role").orderBy("ord", "place")
    e = b.evidence().join(b.observations().select("obs_id", "edition"), "obs_id")
    return e.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 2").select("obs_id", "benchmark_id", "role", "ord", "place", "edition", "rank")


@query("A11 A36", "obs uses", "e AS (SELECT DISTINCT obs_id FROM uses WHERE role = 'evaluates_on'), t AS (SELECT DISTINCT obs_id FROM uses WHERE role = 'trains_on') SELECT edition, count(*) AS papers, count(e.obs_id) AS eval_papers, count(t.obs_id) AS train_papers, count(*) FILTER (e.obs_id IS NOT NULL AND t.obs_id IS NOT NULL) AS both_papers FROM obs o LEFT JOIN e ON e.obs_id = o.obs_id LEFT JOIN t ON t.obs_id = o.obs_id GROUP BY ROLLUP (edition)")
def coverage_funnel(b):
    roles = b.uses().groupBy("obs_id").agg(F.bool_or(F.col("role") == "evaluates_on").alias("e"), F.bool_or(F.col("role") == "trains_on").alias("t"))
    return b.observations().join(roles, "obs_id", "left").rollup("edition").agg(F.count("*").alias("papers"), F.count_if("e").alias("eval_papers"), F.count_if("t").alias("train_papers"), F.count_if(F.col("e") & F.col("t")).alias("both_papers"))


@query("W04 W03", "obs", "SELECT venue, edition FROM (SELECT venue, edition, row_number() OVER (PARTITION BY venue ORDER BY year DESC) AS r FROM (SELECT DISTINCT venue, edition, year FROM obs)) WHERE r <= 2")
def latest_two_editions(b):
    w = Window.partitionBy("venue").orderBy(F.desc("year"))
    return b.observations().select("venue", "edition", "year").distinct().withColumn("r", F.row_number().over(w)).filter("r <= 2").select("venue", "edition")


MOVES = f"""two AS (SELECT venue, edition, row_number() OVER (PARTITION BY venue ORDER BY year DESC) AS r FROM (SELECT DISTINCT venue, edition, year FROM obs)),
side AS (SELECT o.obs_id, o.venue, t.r FROM obs o JOIN two t ON t.venue = o.venue AND t.edition = o.edition AND t.r <= 2),
n AS (SELECT venue, count(*) FILTER (r = 2) AS n0, count(*) FILTER (r = 1) AS n FROM side GROUP BY 1),
c AS (SELECT s.venue, u.benchmark_id, count(DISTINCT u.obs_id) FILTER (r = 2) AS k0, count(DISTINCT u.obs_id) FILTER (r = 1) AS k FROM uses u JOIN side s ON s.obs_id = u.obs_id GROUP BY ALL),
z AS (SELECT *, {Z} AS z FROM c JOIN n USING (venue)) """


@query("A27 A30 A33 M03 M04", "obs uses", MOVES + "SELECT venue, benchmark_id, k0, k, round(z, 4) AS z, CASE WHEN z >= 1.5 THEN 'up' WHEN z <= -1.5 THEN 'down' ELSE 'flat' END AS lane FROM z WHERE k0 + k >= 4")
def movers(b):
    """Entries in the latest edition of a venue against the one before."""
    c = _sides(b)
    z = two_proportion_z(F.col("k0"), F.col("n0"), F.col("k"), F.col("n"))
    return c.filter("k0 + k >= 4").select("venue", "benchmark_id", "k0", "k", F.round(z, 4).alias("z"), F.when(z >= 1.5, "up").when(z <= -1.5, "down").otherwise("flat").alias("lane"))


def _sides(b):
    w = Window.partitionBy("venue").orderBy(F.desc("year"))
    two = b.observations().select("venue", "edition", "year").distinct().withColumn("r", F.row_number().over(w)).filter("r <= 2").drop("year")
    side = b.observations().join(two, ["venue", "edition"]).select("obs_id", "venue", "r")
    n = side.groupBy("venue").agg(F.count_if(F.col("r") == 2).alias("n0"), F.count_if(F.col("r") == 1).alias("n"))
    used = b.uses().select("obs_id", "benchmark_id").distinct().join(side, "obs_id")
    return used.groupBy("venue", "benchmark_id").agg(F.count_if(F.col("r") == 2).alias("k0"), F.count_if(F.col("r") == 1).alias("k")).join(n, "venue")


@query("A31", "obs uses", MOVES + ", l AS (SELECT benchmark_id, count(*) FILTER (z >= 1) AS up, count(*) FILTER (z <= -1) AS down FROM z GROUP BY 1) SELECT benchmark_id, up, down, CASE WHEN up > 0 THEN 'rising' ELSE 'falling' END AS verdict FROM l WHERE (up > 0) <> (down > 0)")
def lane_votes(b):
    """Venues vote; entries on which they disagree are dropped."""
    z = two_proportion_z(F.col("k0"), F.col("n0"), F.col("k"), F.col("n"))
    l = _sides(b).groupBy("benchmark_id").agg(F.count_if(z >= 1).alias("up"), F.count_if(z <= -1).alias("down"))
    return l.filter((F.col("up") > 0) != (F.col("down") > 0)).withColumn("verdict", F.when(F.col("up") > 0, "rising").otherwise("falling"))


@query("A29 A28", "obs uses", MOVES + "SELECT benchmark_id, k::BIGINT AS k FROM (SELECT benchmark_id, sum(k0) AS k0, sum(k) AS k FROM z GROUP BY 1) WHERE k0 = 0 AND k >= 2 ORDER BY k DESC, benchmark_id LIMIT 10")
def fresh(b):
    return _sides(b).groupBy("benchmark_id").agg(F.sum("k0").alias("k0"), F.sum("k").alias("k")).filter("k0 = 0 and k >= 2").orderBy(F.desc("k"), "benchmark_id").limit(10).select("benchmark_id", "k")


@query("A32", "obs uses labels", f"""inset AS (SELECT DISTINCT paper_id FROM olabels WHERE label = 'EUROPE'), s AS (SELECT o.obs_id, o.year, i.paper_id IS NOT NULL AS inside FROM obs o LEFT JOIN inset i ON i.paper_id = o.paper_id),
n AS (SELECT count(*) FILTER (NOT inside) AS n0, count(*) FILTER (inside) AS n FROM s), c AS (SELECT benchmark_id, count(DISTINCT u.obs_id) FILTER (NOT inside) AS k0, count(DISTINCT u.obs_id) FILTER (inside) AS k FROM uses u JOIN s ON s.obs_id = u.obs_id GROUP BY 1), z AS (SELECT benchmark_id, k, k0, {Z} AS z FROM c, n WHERE k >= 5) SELECT benchmark_id, k, k0, round(z, 4) AS z FROM z ORDER BY z DESC, benchmark_id LIMIT 6""")
def inside_movers(b):
    """What a set uses more than the rest."""
    inside = b.labels().filter("label = 'EUROPE'").select("paper_id", F.lit(True).alias("inside")).distinct()
    s = b.observations().join(inside, "paper_id", "left").select("obs_id", F.coalesce("inside", F.lit(False)).alias("inside"))
    n = s.agg(F.count_if(~F.col("inside")).alias("n0"), F.count_if("inside").alias("n"))
    c = b.uses().select("obs_id", "benchmark_id").distinct().join(s, "obs_id").groupBy("benchmark_id").agg(F.count_if(~F.col("inside")).alias("k0"), F.count_if("inside").alias("k"))
    z = two_proportion_z(F.col("k0"), F.col("n0"), F.col("k"), F.col("n"))
    return c.filter("k >= 5").crossJoin(F.broadcast(n)).select("benchmark_id", "k", "k0", z.alias("z")).orderBy(F.desc("z"), "benchmark_id").limit(6).withColumn("z", F.round("z", 4))


@query("A14 W02 M03", "obs labels", f"""n AS (SELECT venue, edition, count(*) AS n FROM obs GROUP BY ALL), c AS (SELECT venue, edition, count(DISTINCT obs_id) AS k FROM obs JOIN olabels USING (paper_id) WHERE label = 'FURNITURE' GROUP BY ALL),
t AS (SELECT n.venue, n.edition, coalesce(k, 0) AS k, n, lag(coalesce(k, 0)) OVER w AS k0, lag(n) OVER w AS n0 FROM n LEFT JOIN c USING (venue, edition) WINDOW w AS (PARTITION BY n.venue ORDER BY n.edition)) SELECT venue, edition, round(k::DOUBLE / n * 1000, 3) AS per_1000, round({Z}, 4) AS z, abs({Z}) >= 2.576 AS significant_99 FROM t""")
def field_trend(b):
    o = b.observations()
    inside = b.labels().filter("label = 'FURNITURE'").select("paper_id", F.lit(1).alias("f")).distinct()
    t = o.join(inside, "paper_id", "left").groupBy("venue", "edition").agg(F.count("f").alias("k"), F.count("*").alias("n"))
    w = Window.partitionBy("venue").orderBy("edition")
    z = two_proportion_z(F.col("k0"), F.col("n0"), F.col("k"), F.col("n"))
    return t.withColumn("k0", F.lag("k").over(w)).withColumn("n0", F.lag("n").over(w)).select("venue", "edition", F.round(F.col("k") / F.col("n") * 1000, 3).alias("per_1000"), F.round(z, 4).alias("z"), (F.abs(z) >= 2.576).alias("significant_99"))


@query("A12 A13", "obs labels", "SELECT label, venue, count(DISTINCT obs_id) AS papers, sum(count(DISTINCT obs_id)) OVER (PARTITION BY label)::BIGINT AS total FROM obs JOIN olabels USING (paper_id) GROUP BY label, venue")
def list_topics(b):
    c = b.observations().join(b.labels(), "paper_id").groupBy("label", "venue").agg(F.count_distinct("obs_id").alias("papers"))
    return c.withColumn("total", F.sum("papers").over(Window.partitionBy("label")))


@query("A42 U08", "obs", "a AS (SELECT edition, count(*) AS n FROM obs WHERE obs_id % 3 <> 0 GROUP BY 1), b AS (SELECT edition, count(*) AS n FROM obs WHERE year > 1995 GROUP BY 1) SELECT coalesce(a.edition, b.edition) AS edition, a.n AS before, b.n AS after, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.edition = b.edition")
def revision_diff(b):
    x = b.observations().filter("obs_id % 3 <> 0").groupBy("edition").agg(F.count("*").alias("before"))
    y = b.observations().filter("year > 1995").groupBy("edition").agg(F.count("*").alias("after"))
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return x.join(y, "edition", "full").withColumn("state", state)


@query("A43", "labels", "a AS (SELECT origin, label, count(*) AS n FROM olabels WHERE paper_id % 2 = 0 GROUP BY ALL), b AS (SELECT origin, label, count(*) AS n FROM olabels WHERE paper_id % 2 = 1 GROUP BY ALL) SELECT coalesce(a.origin, b.origin) AS origin, coalesce(a.label, b.label) AS label, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.origin = b.origin AND a.label = b.label")
def label_delta(b):
    x = b.labels().withColumn("sign", F.when(F.col("paper_id") % 2 == 0, -1).otherwise(1))
    return x.groupBy("origin", "label").agg(F.sum("sign").alias("delta"))


@query("A35 A37", "obs uses bench", f"n AS (SELECT count(*) AS n FROM obs WHERE year = 1996), c AS (SELECT benchmark_id, count(DISTINCT obs_id) AS k FROM uses JOIN obs USING (obs_id) WHERE year = 1996 GROUP BY 1) SELECT name, kind, k, {PCT.format(k='k', n='n')} AS share FROM c JOIN bench ON id = benchmark_id, n ORDER BY k DESC, id LIMIT 150")
def set_benchmarks(b):
    o = b.observations().filter("year = 1996").select("obs_id")
    c = b.uses().join(o, "obs_id", "left_semi").groupBy("benchmark_id").agg(F.count_distinct("obs_id").alias("k"))
    n = o.agg(F.count("*").alias("n"))
    return c.join(b.benchmarks(), F.col("id") == F.col("benchmark_id")).crossJoin(F.broadcast(n)).orderBy(F.desc("k"), "id").limit(150).select("name", "kind", "k", percentage(F.col("k"), F.col("n")).alias("share"))


@query("A39", "obs labels bench uses", "cell AS (SELECT label AS field, brand AS technique, count(DISTINCT o.paper_id) AS n FROM olabels l JOIN obs o USING (paper_id) JOIN uses u USING (obs_id) JOIN bench ON id = benchmark_id WHERE origin = 'declared_area' GROUP BY ALL) SELECT field, technique, n, sum(n) OVER (PARTITION BY field)::BIGINT AS field_papers, sum(n) OVER (PARTITION BY technique)::BIGINT AS technique_papers FROM cell")
def world_cells(b):
    l = b.labels().filter("origin = 'declared_area'").select("paper_id", F.col("label").alias("field"))
    t = b.uses().join(b.benchmarks().select(F.col("id").alias("benchmark_id"), F.col("brand").alias("technique")), "benchmark_id")
    cell = b.observations().join(l, "paper_id").join(t, "obs_id").groupBy("field", "technique").agg(F.count_distinct("paper_id").alias("n"))
    return cell.withColumn("field_papers", F.sum("n").over(Window.partitionBy("field"))).withColumn("technique_papers", F.sum("n").over(Window.partitionBy("technique")))


@query("M04 M03", "obs uses", MOVES + "SELECT venue, benchmark_id, round(abs(z), 3) AS z FROM z WHERE k0 + k >= 6")
def move_sizes(b):
    c = _sides(b).filter("k0 + k >= 6")
    z = two_proportion_z(F.col("k0"), F.col("n0"), F.col("k"), F.col("n"))
    return c.select("venue", "benchmark_id", F.round(F.abs(z), 3).alias("z"))


@query("M04")
def move_p_values(b):
    """Two-sided p; no error function in the SQL dialects, so rows only."""
    c = _sides(b).filter("k0 + k >= 6")
    z = two_proportion_z(F.col("k0"), F.col("n0"), F.col("k"), F.col("n"))
    return c.select("venue", "benchmark_id", F.round(p_value(z), 6).alias("p"), trend_state(F.col("k0"), F.col("n0"), F.col("k"), F.col("n")).alias("state"))
