"""Questions over landed lists, citations, names and readers' marks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lumenlit.operators import reading as R
from lumenlit.plans.registry import query

SUBS = "translate(p_size::VARCHAR, '0123456789', '₀₁₂₃₄₅₆₇₈₉')"


@query("X14", "", f"SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'α' || {SUBS} || ' of ' || p_name WHEN 1 THEN p_name || ' is conditioning' ELSE '50% of ' || p_name END AS shown FROM part")
def tex_titles(b):
    """Titles with TeX, as readers see them."""
    p = b.table("part")
    tex = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(r"$\alpha_{"), "p_size", F.lit(r"}$ of \textbf{\emph{"), "p_name", F.lit("}}"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(r" is condition-  ing \cite{x}"))).otherwise(F.concat(F.lit(r"50\% of "), "p_name"))
    return p.select(F.col("p_partkey").alias("id"), R.detexed(tex).alias("shown"))


@query("X15 X16")
def short_readings(b):
    """Texts shortened by deletion only."""
    def run(many: pd.Series) -> pd.Series:
        return many.map(lambda t: R.elided(t, 200), na_action="ignore")

    return b.documents().select("doc_id", F.pandas_udf(run, "string")(F.col("text")).alias("shown"))


@query("X17 X18", "", "SELECT doc_id, text IS NOT NULL AND len(text) >= 40 AND regexp_matches(substr(text, 1, 40), '[a-zA-Z0-9]') AS stands FROM documents WHERE len(text) >= 40")
def quotes_that_stand(b):
    """A text's own beginning, in other spacing, stands in it."""
    d = b.documents().filter("length(text) >= 40")
    quote = F.regexp_replace(F.substring("text", 1, 40), " ", "  ")
    same = R.quote_stands(quote, F.col("text")) | ~F.substring("text", 1, 40).rlike("[a-zA-Z0-9]")
    return d.select("doc_id", (same & F.substring("text", 1, 40).rlike("[a-zA-Z0-9]")).alias("stands"))


CITED = "r AS (SELECT DISTINCT l_orderkey AS paper, l_partkey AS cited, 'Lee' || chr((97 + l_partkey % 26)::INT) AS name, 1990 + l_partkey % 30 AS year FROM lineitem WHERE l_quantity >= 25)"


def _references(b):
    li = b.table("lineitem").filter("l_quantity >= 25").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("cited")).distinct()
    name = F.concat(F.lit("Lee"), F.char(97 + F.col("cited") % 26))
    year = (1990 + F.col("cited") % 30).cast("string")
    return li.select("paper", "cited", name.alias("name"), year.alias("year"), F.concat(name, F.lit(" et al. A title. In Venue, "), year, F.lit(".")).alias("text"))


@query("J13 W07", "", f"WITH {CITED}, s AS (SELECT paper, 0 AS pos, name, year FROM r QUALIFY row_number() OVER (PARTITION BY paper ORDER BY cited) = 1), h AS (SELECT DISTINCT r.cited, r.paper FROM r JOIN s ON s.paper = r.paper AND s.name = r.name AND s.year = r.year), k AS (SELECT cited, paper, dense_rank() OVER (PARTITION BY cited ORDER BY paper) AS k FROM h) SELECT cited, paper, 0::BIGINT AS pos FROM k WHERE k <= 12")
def citing_sentences(b):
    """Sentences that cite a reference of their paper, a dozen citers each."""
    refs = _references(b)
    first = refs.groupBy("paper").agg(F.min_by(F.struct("name", "year"), "cited").alias("f"))
    sentences = first.select("paper", F.lit(0).cast("long").alias("pos"), F.concat(F.lit("As "), F.col("f.name"), F.lit(" et al. ("), F.col("f.year"), F.lit(") show, it holds.")).alias("text"))
    return R.cite_contexts(refs.select("paper", "cited", "text"), sentences).select("cited", "paper", "pos")


@query("J14", "", f"WITH {CITED} SELECT a.paper, a.name || ' et al' AS name, a.year::VARCHAR AS year, min(b.cited)::BIGINT AS pos FROM r a JOIN r b ON a.paper = b.paper AND a.name = b.name AND a.year = b.year GROUP BY ALL")
def named_references(b):
    """What sentences name, to the first reference with the surname and year."""
    refs = _references(b)
    wanted = refs.select("paper", F.concat("name", F.lit(" et al")).alias("name"), "year").distinct()
    return R.governor_cites(wanted, refs.select("paper", F.col("cited").alias("pos"), "text"))


@query("D24", "", "SELECT p_partkey AS id, p_partkey % 4 <> 2 AS stands FROM part")
def names_in_texts(b):
    """Short names must stand as words in their case, others under their fold."""
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, "results on c-i-f-a-r 10 here").when(k == 1, "we use C4 here").when(k == 2, "we use c4 here").otherwise("the Toy Suite benchmark")
    name = F.when(k == 0, "CIFAR-10").when(k < 3, "C4").otherwise("toysuite")
    return b.table("part").select(F.col("p_partkey").alias("id"), R.names_in(text, name).alias("stands"))


@query("D15", "", "WITH t AS (SELECT unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{2,}'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in dict.fromkeys(R.REGISTER)) + "))) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY 1")
def corpus_words(b):
    return b.documents().select(F.explode(R.corpus_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("D19", "", "SELECT p_type AS kind, p_name AS term, count(*) AS uses, round(avg((p_size > 25)::INT), 3) AS proposed_share, count(*) >= 8 AS graph_worthy FROM part GROUP BY ALL")
def term_shares(b):
    p = b.table("part")
    return R.term_vocabulary(p.select(F.col("p_type").alias("kind"), F.col("p_name").alias("term"), (F.col("p_size") > 25).alias("proposed")))


@query("S17", "", "SELECT c_custkey::VARCHAR AS id, c_name AS title, '2025-01-0' || (c_custkey % 9 + 1) AS datestamp, 'next' AS token FROM customer WHERE c_custkey % 5 <> 0")
def harvested_records(b):
    """Records of landed harvest pages, deleted ones left out."""
    c = b.table("customer")
    record = F.concat(F.lit("<record><header"), F.when(F.col("c_custkey") % 5 == 0, ' status="deleted"').otherwise(""), F.lit("><identifier>oai:x:"), "c_custkey", F.lit("</identifier><datestamp>2025-01-0"), F.col("c_custkey") % 9 + 1, F.lit('</datestamp></header><metadata><dc xmlns="http://purl.org/dc/elements/1.1/"><title>'), "c_name", F.lit("</title></dc></metadata></record>"))
    pages = c.select(F.floor(F.col("c_custkey") / 50).alias("p"), record.alias("r")).groupBy("p").agg(F.concat_ws("", F.collect_list("r")).alias("r"))
    xml = F.concat(F.lit('<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>'), "r", F.lit("<resumptionToken>next</resumptionToken></ListRecords></OAI-PMH>"))
    return R.oai_records(pages.select(F.col("p").cast("string").alias("page"), xml.alias("xml"))).select("id", "title", "datestamp", "token")


@query("S12", "", "SELECT s_nationkey::BIGINT AS issue, s_suppkey::VARCHAR AS id, s_name || ' & co' AS title, 2 AS authors FROM supplier WHERE s_nationkey % 3 <> 0")
def archive_articles(b):
    """Articles of landed issue pages, of the tracks that count."""
    s = b.table("supplier")
    item = F.concat(F.lit('<div class="obj_article_summary"><a href="https://x/article/view/'), "s_suppkey", F.lit('" id="a">\n <b>'), "s_name", F.lit('</b> & co</a><div class="authors">\n A. One, B. Two </div></div>'))
    pages = s.groupBy(F.col("s_nationkey").cast("long").alias("issue")).agg(F.concat_ws("", F.collect_list(item)).alias("items"))
    html = F.concat(F.lit('<html><div class="section"><h2> '), F.when(F.col("issue") % 3 == 0, "Front Matter").otherwise("AAAI Technical Track on X"), F.lit("</h2>"), "items", F.lit("</div></html>"))
    return R.issue_articles(pages.select("issue", html.alias("html"))).select("issue", "id", "title", F.size("authors").alias("authors"))


@query("D42", "obs", "m AS (SELECT o_orderkey AS obs_id, CASE o_orderkey % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'later' WHEN 2 THEN 'not_mine' END AS mark FROM orders WHERE o_orderkey % 3 = 0) SELECT edition, count(*) AS papers, count(*) FILTER (mark = 'read') AS read, count(*) FILTER (mark = 'later') AS later, count(*) FILTER (mark IS DISTINCT FROM 'not_mine') AS shown FROM obs LEFT JOIN m USING (obs_id) GROUP BY 1")
def reading_progress(b):
    """A reader's marks over a set, and what is left when their rejects hide."""
    k = F.col("o_orderkey") % 4
    m = b.table("orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("obs_id"), F.when(k == 0, "read").when(k == 1, "later").when(k == 2, "not_mine").alias("mark"))
    j = b.observations().join(m, "obs_id", "left")
    return j.groupBy("edition").agg(F.count("*").alias("papers"), F.count_if(F.col("mark") == "read").alias("read"), F.count_if(F.col("mark") == "later").alias("later"), F.count_if(~F.col("mark").eqNullSafe("not_mine")).alias("shown"))


@query("D34", "obs", "d AS (SELECT o_orderkey AS obs_id, lower(substr(o_orderpriority, 3)) || '-' || year(o_orderdate) AS edition, o_orderstatus AS decision FROM orders WHERE o_orderkey % 9 = 0) SELECT edition, decision, count(*) AS n FROM d WHERE edition IN (SELECT edition FROM obs WHERE year = 1997) GROUP BY ALL")
def decisions_of_editions(b):
    """Reviewed decisions, only of the editions that are built."""
    d = b.table("orders").filter("o_orderkey % 9 = 0").select(F.concat_ws("-", F.lower(F.expr("substr(o_orderpriority, 3)")), F.year("o_orderdate")).alias("edition"), F.col("o_orderstatus").alias("decision"))
    built = b.observations().filter("year = 1997").select("edition").distinct()
    return d.join(built, "edition", "left_semi").groupBy("edition", "decision").agg(F.count("*").alias("n"))


@query("E20", "", "SELECT page_id, url, regexp_replace(regexp_replace(url, '^http:', 'https:'), '/+$', '') AS corrected, CASE WHEN html IS NULL OR html = '' THEN 'unreachable' WHEN contains(lower(html), 'not found') THEN 'gone' ELSE 'answers' END AS observed FROM pages")
def observed_links(b):
    """Links as written, their corrected address and what was seen there."""
    url, html = F.col("url"), F.col("html")
    observed = F.when(html.isNull() | (html == ""), "unreachable").when(F.lower(html).contains("not found"), "gone").otherwise("answers")
    return b.table("pages").select("page_id", url, F.regexp_replace(F.regexp_replace(url, "^http:", "https:"), "/+$", "").alias("corrected"), observed.alias("observed"))


@query("D04", "", "WITH l AS (SELECT l_orderkey AS paper, min(l_shipdate) AS dated, count(DISTINCT l_partkey) AS named FROM lineitem WHERE l_quantity >= 40 GROUP BY 1) SELECT o_orderkey AS paper, true AS link_index_loaded, coalesce(named, 0) AS named, dated::DATE AS dated FROM orders LEFT JOIN l ON paper = o_orderkey")
def paper_links(b):
    """Names and the first dated fact of each paper: none is not unknown."""
    l = b.table("lineitem").filter("l_quantity >= 40").groupBy(F.col("l_orderkey").alias("paper")).agg(F.min("l_shipdate").cast("date").alias("dated"), F.count_distinct("l_partkey").alias("named"))
    return b.table("orders").select(F.col("o_orderkey").alias("paper")).join(l, "paper", "left").select("paper", F.lit(True).alias("link_index_loaded"), F.coalesce("named", F.lit(0)).alias("named"), "dated")


@query("S23", "", "SELECT doc_id, len(text) AS n FROM documents WHERE doc_id IN (1, 17, 170)")
def texts_by_id(b):
    """Texts by id: the filter reaches the row groups' statistics."""
    return b.documents().filter(F.col("doc_id").isin(1, 17, 170)).select("doc_id", F.length("text").cast("long").alias("n"))
