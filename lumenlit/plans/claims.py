"""Questions over claims in sentences, identity, figures and empty cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenlit.operators import cells as Ce
from lumenlit.operators import claims as C
from lumenlit.operators import figures as Fg
from lumenlit.operators import identity as I
from lumenlit.operators import stages as St
from lumenlit.plans.registry import query

NAMES = ["GSM8K", "C4", "CIFAR-10", "MS-MARCO"]
_LIST = "['GSM8K', 'C4', 'CIFAR-10', 'MS-MARCO']"
_KEYS = "['gsm8k', 'c4', 'cifar10', 'msmarco']"
PAIR = f"x AS (SELECT p_partkey AS id, p_partkey % 6 AS t, {_KEYS}[p_size % 4 + 1] AS n, {_KEYS}[(p_size + 1) % 4 + 1] AS m FROM part)"
ROLES = PAIR + ", r AS (SELECT id, n AS key, CASE WHEN t IN (0, 2, 5) THEN 'trains_on' WHEN t = 4 THEN 'evaluates_on' END AS role FROM x UNION ALL SELECT id, m, 'evaluates_on' FROM x WHERE t = 0)"


def _words(ambiguous=()):
    return C.Vocabulary({n: C.fold_name(n) for n in [*NAMES, *ambiguous]}, [*NAMES, *ambiguous], [C.fold_name(n) for n in ambiguous])


def _sentences(b, templates: list[str], place: str = "method", every: int = 1):
    """Sentences made from the rows of a table: {n} and {m} are known names,
    {own} is a name of the row's own."""
    names = F.array(*map(F.lit, NAMES))
    text = F.element_at(F.array(*map(F.lit, templates)), (F.col("p_partkey") % len(templates) + 1).cast("int"))
    filled = F.replace(F.replace(F.replace(text, F.lit("{n}"), F.element_at(names, (F.col("p_size") % 4 + 1).cast("int"))), F.lit("{m}"), F.element_at(names, ((F.col("p_size") + 1) % 4 + 1).cast("int"))), F.lit("{own}"), F.concat(F.lit("Lum"), F.col("p_partkey").cast("string"), F.lit("Bench")))
    return b.table("part").select(F.floor(F.col("p_partkey") / every).cast("long").alias("id"), (F.col("p_partkey") % every).cast("long").alias("pos"), F.lit(place).alias("place"), filled.alias("text"))


STATED = ["We train on {n} and evaluate on {m}.", "They were trained on {n}.", "Our training data consists of {n}.", "{n} contains many items.", "Experiments are conducted on {n}.", "We then fine-tune a model on {n} for one epoch."]


@query("E05 E04", "", f"WITH {ROLES} SELECT * FROM r")
def stated_roles(b):
    """What sentences say the paper did with the names in them."""
    return C.read_claims(_sentences(b, STATED), _words()).filter("kind = 'mention'").select("id", "key", "role")


@query("E06", "", f"WITH {PAIR} SELECT id, n AS key, CASE id % 4 WHEN 0 THEN 'trains_on' WHEN 2 THEN NULL ELSE 'evaluates_on' END AS role FROM x UNION ALL SELECT id, m, 'evaluates_on' FROM x WHERE id % 4 = 1")
def caption_roles(b):
    """What a caption says of the names in it and in its cells."""
    made = _sentences(b, ["Table 12: Training data taken from {n}.", "Table 2: Results on {n} and {m}.", "Table 1: Statistics of {n}.", "Table 3: Performance comparison on {n}."], "table:caption")
    return C.read_claims(made, _words()).select("id", "key", "role")


@query("E07", "", "SELECT p_partkey AS id, 'clear' AS key, 'evaluates_on' AS role FROM part WHERE p_partkey % 3 <> 1 UNION ALL SELECT p_partkey, 'cifar10', 'evaluates_on' FROM part WHERE p_partkey % 3 = 1")
def ambiguous_names(b):
    """A name that is also a word counts where a data word is attached to it."""
    made = _sentences(b, ["Results on the CLEAR dataset improve.", "We compare CLEAR with other methods on the CIFAR-10 dataset.", "We evaluate on CLEAR, a land-cover dataset."])
    return C.read_claims(made, _words(["CLEAR"])).filter("kind = 'mention'").select("id", "key", "role")


@query("E08", "", "WITH x AS (SELECT p_partkey AS id, p_partkey % 3 AS t, 'Lum' || p_partkey || 'Bench' AS own FROM part) SELECT id, own AS name, CASE t WHEN 0 THEN 'evaluates_on' ELSE 'trains_on' END AS role FROM x WHERE t <> 1 UNION ALL SELECT id, 'Objects-with-Lighting', 'evaluates_on' FROM x WHERE t = 0")
def unlisted_claims(b):
    """Unknown names in the list behind a stated role."""
    made = _sentences(b, ["We evaluate our method on three datasets: {own} (Kuang et al., 2024), Objects-with-Lighting and GSM8K.", "We compare with {own} and BarGAN.", "We fine-tune Llama on {own}."])
    return C.read_claims(made, _words()).filter("kind = 'unlisted'").select("id", F.col("surface").alias("name"), "role")


@query("E09 X19", "", "SELECT p_partkey AS id, 'Lum' || p_partkey || 'Bench' AS name, CASE WHEN p_partkey % 6 IN (0, 3) THEN 'benchmark' ELSE 'dataset' END AS noun FROM part WHERE p_partkey % 6 NOT IN (2, 4)")
def introduced_names(b):
    """Names that a paper says it built."""
    made = _sentences(b, ["We introduce {own}, a benchmark for sports reasoning.", "In this paper, we curate a dataset called {own} of 15k items.", "We propose {own}, a framework for benchmark construction.", "We present a new large-scale benchmark, {own}, covering all.", "Prior work built and released {own}, a dataset of images.", "We release the {own} dataset."])
    return C.read_claims(made, _words()).filter("kind = 'introduces'").select("id", F.col("surface").alias("name"), F.col("role").alias("noun"))


@query("E11 A19", "", f"WITH {ROLES}, o AS (SELECT id // 10 AS id, key, role FROM r) SELECT id, key, count(*) AS n, coalesce(string_agg(DISTINCT role, ',' ORDER BY role), '') AS roles, least(3, count(*)) AS evidence FROM o GROUP BY id, key")
def paper_mentions(b):
    """One row for each paper and name, with its roles and first passages."""
    p = C.papers_of(C.read_claims(_sentences(b, STATED, every=10), _words()).filter("kind = 'mention'"))
    # two names of one sentence are two rows; the templates go by the row's key, not its place
    return p.select("id", "key", "n", F.array_join("roles", ",").alias("roles"), F.size("evidence").cast("long").alias("evidence"))


@query("T07", "", "WITH RECURSIVE v AS (SELECT 0::BIGINT AS name UNION SELECT p_partkey::BIGINT FROM part JOIN v ON p_partkey // 1000 = v.name) SELECT name FROM v")
def settled_vocabulary(b):
    """Names found through known names, again until nothing is new."""
    p = b.table("part").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 1000).cast("long").alias("name"))
    return C.settle(lambda v: p.join(v, "name", "left_semi").select(F.col("child").alias("name")), b.spark.range(1).select(F.col("id").alias("name")))


# --- identity -------------------------------------------------------------------------------------------------------


LISTED = """x AS (SELECT o_orderkey AS event, o_orderkey // 2 AS k, CASE WHEN o_orderstatus = 'F' THEN 'Oral' ELSE 'Poster' END AS eventtype, o_custkey % 3 AS a FROM orders),
p AS (SELECT a.event, a.k, a.eventtype, b.event AS other, b.eventtype AS other_type, (a.a = 2 OR b.a = 2 OR a.a = b.a) AND a.k % 5 <> 0 AS same FROM x a LEFT JOIN x b ON a.k = b.k AND a.event <> b.event)"""


def _listings(b):
    o = b.table("orders")
    k = F.floor(F.col("o_orderkey") / 2).cast("long")
    oral = F.col("o_orderstatus") == "F"
    by_id, apart = k % 5 == 4, k % 5 == 0
    person = F.when(F.col("o_custkey") % 3 == 0, "Ann Leé").when(F.col("o_custkey") % 3 == 1, "Bob Ray")
    uid = F.when(by_id & (F.col("o_orderkey") % 2 == 1), None).otherwise(F.concat(F.lit("u"), F.when(apart, F.col("o_orderkey")).otherwise(k).cast("string")))
    return o.select(F.col("o_orderkey").alias("event"), F.when(oral, "Oral").otherwise("Poster").alias("eventtype"), F.concat(F.lit("Title "), (k % 97).cast("string")).alias("title"), F.array_compact(F.array(person)).alias("authors"), F.when(by_id, F.concat(F.lit("https://openreview.net/forum?id=F"), k.cast("string"))).otherwise(F.concat(F.lit("https://openreview.net/forum?id=2025-Oral--"), k.cast("string"))).alias("url"), F.when(oral, -(k + 1)).otherwise(k + 1).cast("string").alias("sourceid"), uid.alias("uid"), F.when(oral & (k % 7 == 0), "None").otherwise(F.lit("track")).alias("source"), F.col("o_orderkey").alias("record"))


@query("G02 X10 K08", "", f"WITH {LISTED} SELECT event::VARCHAR AS event, CASE WHEN other IS NULL OR NOT same OR (eventtype, event::VARCHAR) < (other_type, other::VARCHAR) THEN event ELSE other END::VARCHAR AS paper, CASE WHEN other IS NULL OR NOT same THEN '' WHEN k % 5 = 4 THEN 'openreview' ELSE 'feed' END AS rules FROM p")
def paper_identity(b):
    """Listings that are one paper, by official ids and feed links."""
    return I.identify(_listings(b)).select("event", "paper", F.array_join("rules", ",").alias("rules"))


@query("G04 G05")
def merged_catalogue(b):
    """Entries that one paper introduces under one name and kind are one."""
    p = b.benchmarks()
    brand = F.array("brand")
    entities = p.select("id", F.concat_ws(" ", "name", "brand").alias("name_key"), "kind", (F.col("id") % 10 == 0).alias("registered"), F.array("name").alias("aliases"), brand.alias("developers"))
    li = b.table("lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("claim"))
    claims = li.join(b.observations().select("obs_id", F.col("paper_id").alias("paper"), "edition", "year"), "obs_id").select("id", "claim", "paper", "edition", "year")
    merged, _ = I.merge_entities(entities, claims)
    return merged.select("id", F.size("merged_ids").cast("long").alias("merged"), F.size(F.coalesce("claims", F.array().cast("array<long>"))).cast("long").alias("claims"), "first_edition")


# --- figures --------------------------------------------------------------------------------------------------------

@query("N01 N04 N03 M09", "", r"""WITH f AS (SELECT DISTINCT p_partkey % 40 AS turn, p_size::DOUBLE AS v FROM part), q AS (SELECT DISTINCT conv_id AS turn, turn AS id FROM conversations),
a AS (SELECT turn, id, (id * 7 + turn) % 120 AS n FROM q), s AS (SELECT turn, v, row_number() OVER (PARTITION BY turn ORDER BY v) AS i FROM f),
d AS (SELECT DISTINCT turn, round_even(c, 0) AS c FROM (SELECT a.turn, unnest([a.v - b.v, b.v - a.v, a.v + b.v, CASE WHEN b.v <> 0 THEN a.v / b.v * 100 END, CASE WHEN a.v <> 0 THEN b.v / a.v * 100 END, CASE WHEN b.v <> 0 THEN a.v / b.v END, CASE WHEN a.v <> 0 THEN b.v / a.v END]) AS c FROM s a JOIN s b ON a.turn = b.turn AND a.i < b.i WHERE a.i <= 120 AND b.i <= 120) WHERE c BETWEEN 0 AND 1e7)
SELECT turn, id, n::BIGINT AS n, CASE WHEN n IN (SELECT v FROM f WHERE f.turn = a.turn) THEN 'ok' WHEN EXISTS (SELECT 1 FROM d WHERE d.turn = a.turn AND d.c = n) THEN 'derived' ELSE 'no' END AS verdict FROM a""")
def turn_verdicts(b):
    """Figures of answers against what the turn's tools returned."""
    facts = b.table("part").select((F.col("p_partkey") % 40).alias("turn"), F.col("p_size").cast("double").alias("value")).distinct()
    n = (F.col("turn") * 7 + F.col("conv_id")) % 120
    answers = b.table("conversations").select(F.col("conv_id").alias("turn"), F.col("turn").alias("id"), F.format_string("It lists %d papers.", n).alias("text")).distinct()
    found = Fg.figures(answers.select(F.struct("turn", "id").alias("who"), "text").select(F.xxhash64("who").alias("id"), "who", "text")).withColumnRenamed("id", "h")
    keys = answers.select(F.xxhash64(F.struct("turn", "id")).alias("h"), "turn", "id")
    rows = found.join(keys, "h").select("turn", "id", "at", "value", "places")
    return Fg.verdicts(rows, facts).select("turn", "id", F.col("value").cast("long").alias("n"), "verdict")


@query("N05 N06 D21", "", """WITH x AS (SELECT p_partkey AS turn, p_size AS n, p_partkey % 3 AS t FROM part) SELECT turn, 1::BIGINT AS id, CASE t WHEN 0 THEN 'ok' WHEN 1 THEN 'misplaced' ELSE 'no' END AS verdict FROM x""")
def connected_figures(b):
    """A number that a tool returned for something else does not verify a figure."""
    p = b.table("part")
    n = F.col("p_size").cast("long")
    facts = p.select(F.col("p_partkey").alias("turn"), F.inline(F.array(F.struct(F.lit("").alias("subject"), F.lit("paper").alias("measure"), n.cast("double").alias("value")), F.struct(F.lit("").alias("subject"), F.lit("edition").alias("measure"), (n + 1000).cast("double").alias("value")))))
    text = F.when(F.col("p_partkey") % 3 == 0, F.format_string("It was used in %d papers.", n)).when(F.col("p_partkey") % 3 == 1, F.format_string("It covers %d editions.", n)).otherwise(F.format_string("It was used in %d papers.", n + 500))
    found = Fg.figures(p.select(F.col("p_partkey").alias("id"), text.alias("text"))).select(F.col("id").alias("turn"), F.lit(1).cast("long").alias("id"), "at", "value", "places", "unit", "clause")
    return Fg.connected_verdicts(found, facts).select("turn", "id", "verdict")


@query("N07", "", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 2 END::BIGINT AS pieces, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS anchors, 1::BIGINT AS quotes FROM documents")
def answer_segments(b):
    """Answers cut into prose, quotes and anchored figures."""
    text = F.when(F.col("doc_id") % 2 == 0, 'There are [[usage:{"k": 1}|12]] papers, "as it says" there.').otherwise('It says "yes 12"')
    s = Fg.segments(b.documents().select(F.col("doc_id").alias("id"), text.alias("text")))
    return s.groupBy("id").agg(F.count("*").alias("pieces"), F.count_if(F.col("kind") == "anchor").alias("anchors"), F.count_if(F.col("kind") == "quote").alias("quotes"))


# --- empty cells ----------------------------------------------------------------------------------------------------

WORLD = """li AS (SELECT o_custkey AS paper, year(o_orderdate) AS y, l_partkey, l_returnflag AS flag, l_quantity >= 45 AND l_discount >= 0.1 - 1e-9 AS tech FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
base AS (SELECT c_custkey AS paper, n_name AS f FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 5 <> 0),
used AS (SELECT DISTINCT paper, p_type AS t FROM li JOIN part ON p_partkey = l_partkey WHERE y <= 1996 AND tech),
lims AS (SELECT DISTINCT paper, p_brand AS w FROM li JOIN part ON p_partkey = l_partkey WHERE y <= 1996 AND flag = 'A'),
clms AS (SELECT DISTINCT paper, p_brand AS w FROM li JOIN part ON p_partkey = l_partkey WHERE y <= 1996 AND flag = 'R'),
fs AS (SELECT f, count(*) AS nf FROM base GROUP BY 1 HAVING count(*) >= 3), ts AS (SELECT t, count(*) AS nt FROM used GROUP BY 1 HAVING count(*) >= 3),
cells AS (SELECT DISTINCT f, t FROM used JOIN base USING (paper) JOIN fs USING (f) JOIN ts USING (t)),
empty AS (SELECT f, nf, t, nt FROM fs, ts WHERE (f, t) NOT IN (SELECT (f, t) FROM cells)),
fk AS (SELECT f, count(*) AS k FROM cells GROUP BY 1), tk AS (SELECT t, count(*) AS k FROM cells GROUP BY 1),
ff AS (SELECT a.f AS a, b.f AS b, count(*) AS s FROM cells a JOIN cells b ON a.t = b.t AND a.f <> b.f GROUP BY ALL), fj AS (SELECT a, b, s / (x.k + y.k - s)::DOUBLE AS j FROM ff JOIN fk x ON x.f = a JOIN fk y ON y.f = b),
tt AS (SELECT a.t AS a, b.t AS b, count(*) AS s FROM cells a JOIN cells b ON a.f = b.f AND a.t <> b.t GROUP BY ALL), tj AS (SELECT a, b, s / (x.k + y.k - s)::DOUBLE AS j FROM tt JOIN tk x ON x.t = a JOIN tk y ON y.t = b),
cf1 AS (SELECT fj.a AS f, c.t, sum(j) AS x FROM cells c JOIN fj ON fj.b = c.f GROUP BY ALL), cf2 AS (SELECT c.f, tj.a AS t, sum(j) AS y FROM cells c JOIN tj ON tj.b = c.t GROUP BY ALL),
rw AS (SELECT paper, f FROM base), n AS (SELECT count(*) AS n FROM rw), ev AS (SELECT paper, w FROM lims JOIN rw USING (paper) UNION SELECT paper, w FROM clms JOIN rw USING (paper)),
idf AS (SELECT w, ln(n::DOUBLE / count(*)) AS idf FROM ev, n GROUP BY w, n HAVING count(*) >= 3 AND count(*) <= n * 0.9),
ln AS (SELECT f, count(DISTINCT paper) AS k FROM lims JOIN rw USING (paper) JOIN fs USING (f) GROUP BY 1), lv0 AS (SELECT f, w, count(*)::DOUBLE / k * idf AS v FROM lims JOIN rw USING (paper) JOIN ln USING (f) JOIN idf USING (w) GROUP BY f, w, k, idf), lv AS (SELECT f, w, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY f)), 0) AS v FROM lv0),
tn AS (SELECT t, count(DISTINCT paper) AS k FROM used JOIN rw USING (paper) JOIN ts USING (t) WHERE paper IN (SELECT paper FROM clms) GROUP BY 1), tv0 AS (SELECT t, w, count(*)::DOUBLE / k * idf AS v FROM used JOIN rw USING (paper) JOIN clms USING (paper) JOIN tn USING (t) JOIN idf USING (w) GROUP BY t, w, k, idf), tv AS (SELECT t, w, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY t)), 0) AS v FROM tv0),
lim AS (SELECT f, t, sum(lv.v * tv.v) AS lim FROM lv JOIN tv USING (w) GROUP BY ALL),
s AS (SELECT e.f, e.t, nf * nt::DOUBLE AS pa, coalesce(x, 0) + coalesce(y, 0) AS cf, coalesce(lim, 0) AS lim, coalesce(tk.k, 0) AS k FROM empty e LEFT JOIN cf1 ON cf1.f = e.f AND cf1.t = e.t LEFT JOIN cf2 ON cf2.f = e.f AND cf2.t = e.t LEFT JOIN lim ON lim.f = e.f AND lim.t = e.t LEFT JOIN tk ON tk.t = e.t)"""


def _world(b, later: bool = False):
    li = b.table("lineitem").join(b.table("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(b.table("part").select("p_partkey", "p_type", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    year = F.year("o_orderdate") > 1996 if later else F.year("o_orderdate") <= 1996
    tech = (F.col("l_quantity") >= 45) & (F.col("l_discount") >= 0.1 - 1e-9)
    set_of = lambda cond, c: F.collect_set(F.when(cond, F.col(c)))
    own = li.filter(year).groupBy(F.col("o_custkey").alias("paper")).agg(set_of(tech, "p_type").alias("techniques"), set_of(F.col("l_returnflag") == "A", "p_brand").alias("limits"), set_of(F.col("l_returnflag") == "R", "p_brand").alias("claims"))
    who = b.table("customer").join(b.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("paper"), F.when(F.col("c_custkey") % 5 != 0, F.col("n_name")).alias("field"))
    return who.join(own, "paper", "left").withColumn("techniques", F.coalesce("techniques", F.array().cast("array<string>")))


@query("V14 M05 M08", "", f"WITH {WORLD}, m AS (SELECT min(lim) AS l0, max(lim) AS l1, min(cf) AS c0, max(cf) AS c1 FROM s) SELECT f, t, pa, round(cf, 6) AS cf, round(lim, 6) AS lim, round(CASE WHEN l1 > l0 THEN (lim - l0) / (l1 - l0) ELSE 0 END * CASE WHEN c1 > c0 THEN (cf - c0) / (c1 - c0) ELSE 0 END, 6) AS lim_cf, round(lim / ln(2 + k), 6) AS lim_spec FROM s, m")
def empty_cell_scores(b):
    """Pairs of a field and a technique that no paper joins, scored six ways."""
    s = Ce.score_cells(_world(b), 3, 3, high=0.9)
    return s.select("f", "t", "pa", *[F.round(c, 6).alias(c) for c in ("cf", "lim", "lim_cf", "lim_spec")])


@query("V14 D14")
def cell_validation(b):
    """How many of the cells ranked first were filled later; by a hash for the
    random scorer, so rows only."""
    later = Ce.world(_world(b, later=True), 1, 1)[2]
    return Ce.validate(Ce.score_cells(_world(b), 3, 3, high=0.9), later)


# --- stages ---------------------------------------------------------------------------------------------------------


@query("T02 D32 D33", "", "SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'gone' WHEN doc_id % 2 = 1 THEN 'new' ELSE 'changed' END AS change FROM documents WHERE doc_id % 8 = 0 OR doc_id % 2 = 1 OR doc_id % 6 = 0")
def rows_to_redo(b):
    """Rows that are new, gone or changed since a stage last read them."""
    d = b.documents().select("doc_id", "text", "lang")
    old = d.filter("doc_id % 2 = 0")
    new = d.filter("doc_id % 8 != 0").withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return St.changed_rows(new, old, "doc_id")
