"""Questions over texts: search, terms, matching, extraction rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenlit.functions import text as X
from lumenlit.operators import match as M
from lumenlit.operators import search as S
from lumenlit.plans.engine import FOLD
from lumenlit.plans.registry import query

NORM = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
WORDS = "list_filter(string_split(" + NORM + ", ' '), lambda w: w <> '')"
TOKS = "list_distinct(list_filter(string_split(" + NORM + ", ' '), lambda w: len(w) > 2 AND w NOT IN ('the','and','for','with','via','from','into','using','based','その')))"
TERMS = "w AS (SELECT doc_id AS id, " + WORDS.format(x="text") + " AS w FROM documents), post AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(w) AS term FROM w UNION ALL SELECT id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM w))"


def docs(b):
    return b.documents().select(F.col("doc_id").alias("id"), "text")


@query("V01 U04", "", "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'the') AND contains(lower(text), 'license') ORDER BY id LIMIT 50")
def search_words(b):
    return S.search_all(docs(b), ["tion", "the", "license"])


@query("V02", "", "WITH " + TERMS + " SELECT term, count(*) AS docs FROM post WHERE term LIKE 'licen%' OR term LIKE 'quel%' GROUP BY 1")
def search_prefix(b):
    return S.terms(docs(b), wanted=lambda t: t.startswith("licen") | t.startswith("quel")).groupBy("term").agg(F.count("*").alias("docs"))


@query("V03 M05 S24", "", "WITH " + TERMS + ", d AS (SELECT term, count(*) AS df FROM post WHERE term IN ('license', 'public', 'version', 'all rights') GROUP BY 1) SELECT id, round(sum(ln(1 + 1000.0 / df)), 6) AS score, count(*) AS hits FROM post JOIN d USING (term) GROUP BY id")
def search_scores(b):
    return S.hit_scores(docs(b), ["license", "public", "version", "all rights"], 1000)


@query("A15 D05 X03", "", "WITH " + TERMS + ", n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df FROM post, n GROUP BY term, n HAVING count(*) >= greatest(3, n // 60) AND count(*) <= 0.5 * n")
def gap_terms(b):
    return S.frequent_terms(docs(b), 3, 60, 0.5)


@query("A16 K05 K09", "", "WITH " + TERMS + """, q AS (SELECT doc_id, quality, toxic FROM labels), named AS (SELECT term, count(*) AS named_by, count(*) FILTER (toxic = 1) AS attacked_by, min((n_chars, doc_id))[2] AS shortest FROM post JOIN documents ON doc_id = id LEFT JOIN q USING (doc_id) WHERE term IN ('license', 'public license', 'version', 'garbage', 'stupid', 'moron', 'idiot') GROUP BY 1) SELECT * FROM named""")
def gap_branches(b):
    """Per term: texts that name it, those marked, and the shortest of them."""
    p = S.terms(docs(b), wanted=lambda t: t.isin("license", "public license", "version", "garbage", "stupid", "moron", "idiot"))
    rows = p.join(b.documents().select(F.col("doc_id").alias("id"), "n_chars"), "id").join(b.table("labels").select(F.col("doc_id").alias("id"), "toxic"), "id", "left")
    return rows.groupBy("term").agg(F.count("*").alias("named_by"), F.count_if(F.col("toxic") == 1).alias("attacked_by"), F.min(F.struct("n_chars", "id"))["id"].alias("shortest"))


@query("A26 V10", "", "WITH " + TERMS + """, c AS (SELECT doc_id AS id, lang AS cls FROM documents), sz AS (SELECT cls, count(*) AS n FROM c GROUP BY 1), al AS (SELECT count(*) AS a FROM c),
i AS (SELECT cls, term, count(*) AS c FROM post JOIN c USING (id) GROUP BY ALL HAVING count(*) >= 3), g AS (SELECT term, count(*) AS g FROM post GROUP BY 1),
s AS (SELECT cls, term, i.c, round((i.c::DOUBLE / n + 0.02) / ((g - i.c)::DOUBLE / greatest(1, a - n) + 0.02) * ln(1 + i.c), 6) AS score FROM i JOIN g USING (term) JOIN sz USING (cls), al)
SELECT cls, term, c, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 5""")
def class_labels(b):
    return S.class_terms(b.documents().select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("cls")))


@query("J12 J15 E19 G10", "", "WITH p AS (SELECT item_id, ' ' || " + NORM.format(x="text") + " || ' ' AS p FROM benchmark), d AS (SELECT doc_id, ' ' || " + NORM.format(x="text") + " || ' ' AS t FROM documents) SELECT item_id AS passage_id, doc_id AS text_id FROM p JOIN d ON contains(t, p) WHERE len(p) >= 22")
def contained_passages(b):
    return M.contained_passages(b.table("benchmark").select(F.col("item_id").alias("id"), "text"), docs(b))


def _titles(b):
    p = b.table("part")
    return p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title")), p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))


T2 = "WITH l AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type AS title FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type AS title FROM part WHERE p_partkey % 2 = 1)"


@query("J08 X03", "", T2 + ", i AS (SELECT " + NORM.format(x="title") + " AS key, min(id) AS match_id FROM r GROUP BY 1) SELECT id, match_id FROM l JOIN i ON key = " + NORM.format(x="title"))
def exact_titles(b):
    return M.exact_titles(*_titles(b))


@query("J09 W13 X04 U07", "", T2 + ", x AS (SELECT id, " + TOKS.format(x="title") + " AS t FROM l), y AS (SELECT id, " + TOKS.format(x="title") + " AS t FROM r), s AS (SELECT x.id, y.id AS r, len(list_intersect(x.t, y.t))::DOUBLE / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS score FROM x, y), k AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM s WHERE score >= 0.85 WINDOW w AS (PARTITION BY id ORDER BY score DESC, r)) SELECT id, CASE WHEN nxt IS NOT NULL AND score - nxt < 0.05 THEN NULL ELSE r END AS match_id, round(score, 6) AS score, CASE WHEN nxt IS NOT NULL AND score - nxt < 0.05 THEN 'ambiguous' WHEN score = 1 THEN 'exact' ELSE 'fuzzy' END AS kind FROM k WHERE rank = 1")
def fuzzy_titles(b):
    return M.fuzzy_titles(*_titles(b))


@query("J10 K04")
def best_overlap(b):
    """The 200 titles that share the most tokens, and among these the most alike;
    every title of one half against all of the other. The twin would compare all
    pairs, so brute force on a fixture tests it."""
    left, right = _titles(b)
    return M.best_overlap(left, right, 200, 3)


@query("X01 X03 X04 X05 X20", "", "SELECT p_partkey AS id, " + FOLD.format(x="p_type || ' Benchmark'") + " AS fold, " + NORM.format(x="p_brand") + " AS norm, regexp_replace(lower(regexp_replace(trim(p_name || ' / ' || p_brand || '.'), '[.,;:]+$', '')), '[\\s\\-_/]+', ' ', 'g') AS basic, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part")
def name_keys(b):
    p = b.table("part")
    return p.select(F.col("p_partkey").alias("id"), X.fold(F.concat(F.col("p_type"), F.lit(" Benchmark"))).alias("fold"), X.norm(F.col("p_brand")).alias("norm"), X.basic(F.concat(F.col("p_name"), F.lit(" / "), F.col("p_brand"), F.lit("."))).alias("basic"), X.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query("X11 S11 E02 S30", "", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS host, 'page' AS kind, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"')) AS links FROM pages")
def page_links(b):
    return b.table("pages").select("page_id", X.url_host(F.col("url")).alias("host"), X.url_kind(F.col("url")).alias("kind"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit('<a href="([^"]*)"')).cast("long").alias("links"))


@query("X13 E14 D11", "", "SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\\s+([A-Z(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS n FROM documents")
def sentence_counts(b):
    return b.documents().select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("n"))


@query("F22", "", "SELECT doc_id, len(text) - len(regexp_replace(text, '[\\$\\\\^_{}=<>|#*&%]', '', 'g')) AS marks, (len(text) - len(regexp_replace(text, '[\\$\\\\^_{}=<>|#*&%]', '', 'g'))) < 4 AND len(text) > 0 AS plain FROM documents")
def plain_texts(b):
    marks = F.length("text") - F.length(F.regexp_replace("text", r"[\$\\^_{}=<>|#*&%]", ""))
    return b.documents().select("doc_id", marks.cast("long").alias("marks"), ((marks < 4) & (F.length("text") > 0)).alias("plain"))


@query("A18 A19 W06", "", "WITH n AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Z][a-z]+[A-Z]\\w*|[A-Z]{3,}')) AS name FROM documents) SELECT lower(name) AS key, count(DISTINCT doc_id) AS papers, count(DISTINCT source) AS venues, count(*) AS uses FROM n GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def unlisted_names(b):
    n = b.documents().select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Z][a-z]+[A-Z]\w*|[A-Z]{3,})"), 1)).alias("name"))
    return n.groupBy(F.lower("name").alias("key")).agg(F.count_distinct("doc_id").alias("papers"), F.count_distinct("source").alias("venues"), F.count("*").alias("uses")).filter("papers >= 2")


@query("A21 U03", "", "WITH " + TERMS + ", v AS (SELECT term, count(*) AS df FROM post WHERE term NOT LIKE '% %' GROUP BY 1) SELECT a.term AS plural, b.term AS singular, a.df AS plural_df, b.df AS singular_df FROM v a JOIN v b ON b.term = substr(a.term, 1, len(a.term) - 1) WHERE a.term LIKE '%s' AND len(a.term) > 3")
def plural_merge(b):
    v = S.terms(docs(b), False).groupBy("term").agg(F.count("*").alias("df"))
    p = v.filter(F.col("term").endswith("s") & (F.length("term") > 3)).select(F.col("term").alias("plural"), F.col("df").alias("plural_df"), F.expr("substr(term, 1, length(term) - 1)").alias("singular"))
    return p.join(v.select(F.col("term").alias("singular"), F.col("df").alias("singular_df")), "singular")


@query("A22 A25 M02", "", "WITH c AS (SELECT source AS label, lang AS corpus, count(*) AS k FROM documents GROUP BY ALL), n AS (SELECT lang AS corpus, count(*) AS n FROM documents GROUP BY 1) SELECT label, max(round(k * 1000.0::DOUBLE / n, 3)) AS top_share, sum(k)::BIGINT AS papers, count(*) AS corpora FROM c JOIN n USING (corpus) GROUP BY 1 HAVING max(k * 1000.0 / n) >= 40")
def taxonomy_shares(b):
    d = b.documents()
    n = d.groupBy(F.col("lang").alias("corpus")).agg(F.count("*").alias("n"))
    c = d.groupBy(F.col("source").alias("label"), F.col("lang").alias("corpus")).agg(F.count("*").alias("k")).join(n, "corpus").withColumn("s", F.col("k") * 1000 / F.col("n"))
    return c.groupBy("label").agg(F.round(F.max("s"), 3).alias("top_share"), F.sum("k").alias("papers"), F.count("*").alias("corpora"), F.max("s").alias("m")).filter("m >= 40").drop("m")


@query("A23 U03", "", "WITH " + TERMS + ", e AS (SELECT id FROM post WHERE term = 'public license'), v AS (SELECT DISTINCT id FROM post WHERE term IN ('license', 'licensed')) SELECT id, 'explicit' AS how FROM e UNION ALL SELECT id, 'via_child' FROM v WHERE id NOT IN (SELECT id FROM e)")
def taxonomy_members(b):
    t = S.terms(docs(b), wanted=lambda t: t.isin("public license", "license", "licensed"))
    e = t.filter("term = 'public license'").select("id")
    v = t.filter("term in ('license', 'licensed')").select("id").distinct().join(e, "id", "left_anti")
    return e.withColumn("how", F.lit("explicit")).union(v.withColumn("how", F.lit("via_child")))


@query("N01 J20", "", "WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[0-9][0-9,]*(\\.[0-9]+)?')) AS tok FROM conversations) SELECT conv_id, turn, count(*) AS numbers, round(sum(replace(tok, ',', '')::DOUBLE), 2) AS total FROM t GROUP BY ALL")
def answer_numbers(b):
    t = b.table("conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), 1)).alias("tok"))
    return t.groupBy("conv_id", "turn").agg(F.count("*").alias("numbers"), F.round(F.sum(F.replace("tok", F.lit(","), F.lit("")).cast("double")), 2).alias("total"))


@query("S29 E12", "", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+')) AS contacts, lower(regexp_extract(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+')) AS first_contact FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+')")
def contacts(b):
    mail = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+"
    d = b.documents().filter(F.col("text").rlike(mail))
    return d.select("doc_id", F.regexp_count("text", F.lit(mail)).cast("long").alias("contacts"), F.lower(F.regexp_extract("text", mail, 0)).alias("first_contact"))


@query("F24 D09", "", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)rights reserved|license') THEN 'licence' WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[#*&%]{3}') THEN 'marked' ELSE 'other' END AS family FROM documents")
def first_match_family(b):
    t = F.col("text")
    return b.documents().select("doc_id", F.when(t.rlike("(?i)rights reserved|license"), "licence").when(t.contains(" | "), "table").when(t.rlike("[#*&%]{3}"), "marked").otherwise("other").alias("family"))


@query("W08", "", "WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), c AS (SELECT doc_id, pos, CASE WHEN contains(line, 'License') THEN 'licence' WHEN contains(line, ' | ') THEN 'table' END AS cue FROM s) SELECT doc_id, pos::BIGINT AS pos, last_value(cue IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS role FROM c")
def nearest_cue(b):
    """The last cue at or before each line."""
    s = b.documents().select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    cue = F.when(F.col("line").contains("License"), "licence").when(F.col("line").contains(" | "), "table")
    w = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.last(cue, True).over(w).alias("role"))


@query("A20 X19", "", "SELECT upper(regexp_replace(p_name, '(\\w)\\w*\\s*', '\\1', 'g')) AS acronym, count(*) AS n, min(p_name) AS long_form FROM part GROUP BY 1")
def acronyms(b):
    a = F.upper(F.regexp_replace("p_name", r"(\w)\w*\s*", "$1"))
    return b.table("part").groupBy(a.alias("acronym")).agg(F.count("*").alias("n"), F.min("p_name").alias("long_form"))


@query("A24 G08 A22", "bench", "v AS (SELECT DISTINCT name FROM bench UNION SELECT DISTINCT regexp_extract(name, '(\\w+)$', 1) FROM bench) SELECT a.name AS child, max(b.name) AS parent FROM v a JOIN v b ON ends_with(a.name, ' ' || b.name) GROUP BY 1")
def parents(b):
    """The longest known name that ends a longer one, over a join on the last word."""
    names = b.benchmarks().select("name").distinct()
    v = names.union(names.select(F.regexp_extract("name", r"(\w+)$", 1))).distinct().withColumn("last", F.regexp_extract("name", r"(\w+)$", 1))
    p = v.select(F.col("name").alias("parent"), "last")
    return v.join(p, "last").filter(F.col("name").endswith(F.concat(F.lit(" "), F.col("parent")))).groupBy(F.col("name").alias("child")).agg(F.max("parent").alias("parent"))
