"""TeX, citations, names and landed lists."""

import pytest
from pyspark.sql import functions as F

from lumenlit.operators import reading as R


def test_tex_as_readers_see_it():
    assert R.detex(r"$\alpha + x_{12}$ and $x_i^2$") == "α + x₁₂ and xᵢ²"
    assert R.detex(r"\textbf{\texttt{Foo}} \cite{a}bar \alphabet") == "Foo bar"
    assert R.detex("condition- ing and token- level") == "conditioning and token-level"
    assert R.detex(r"50\% of \$5 {x}") == "50% of $5 x"
    assert R.detex("_neuro models_ of x_Q") == "neuro models of x_(Q)"
    assert R.detex("``a'' ˆV") == "“a” V̂" and R.detex("") == "" and R.detex("\\") == "" and R.detex("{a") == "a" and R.detex("x^") == "x^"


def test_shorter_readings_only_delete():
    t = "However, we find (see Table 2) that the method is better than all the others in most cases"
    for most in (10, 40, 60, 500):
        s = R.elided(t, most)
        assert len(s) <= max(most, 0) or most == 500
        assert R.is_subsequence(s, t)
    assert R.elided(t, 500) == t and not R.is_subsequence("b a", "a b") and R.elided("x" * 30, 10) == "x" * 10


def test_quotes_and_windows(spark):
    rows = [("The model is condition- ing on a long, long prefix.", "model is conditioning on a long long"), ("short", "short"), ("abc " * 20, "Something that isn't in there at all"), (None, "x" * 30)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, q string").select(R.quote_stands(F.col("q"), F.col("s"))).collect()]
    assert got == [True, False, False, None]
    text = "a" * 300 + "HERE" + "b" * 300
    cut = spark.createDataFrame([(text, 301), ("tiny HERE", 6), ("HERE" + "c" * 600, 1)], "s string, p int").select(R.window_around(F.col("s"), F.col("p"), F.lit(4))).collect()
    assert cut[0][0].startswith("…a") and cut[0][0].endswith("b…") and "HERE" in cut[0][0] and len(cut[0][0]) == 422
    assert cut[1][0] == "tiny HERE" and cut[2][0].startswith("HERE") and cut[2][0].endswith("…")


def test_citing_sentences(spark):
    refs = [(1, 10, "Anderson and Rubin. Estimation. 1949."), (1, 11, "Kuang et al. Stanford. 2024a."), (1, 12, "Kuang et al. Other. 2023"), (1, 13, "Li. 1999"), (1, 14, "Anonymous"), (2, 10, "Anderson and Rubin. Estimation. 1949.")]
    texts = [(1, 0, "As Anderson & Rubin (1949) say."), (1, 1, "See Kuang et al., 2024a; Kuang et al. (2023)."), (1, 2, "Kuang et al. (2024) is another."), (1, 3, "Again Anderson and Rubin, 1949."), (1, 4, "Anderson and Rubin (1949) once more."), (2, 0, "Nothing."), (3, 0, "Anderson and Rubin (1949).")]
    r = spark.createDataFrame(refs, "paper long, cited long, text string")
    s = spark.createDataFrame(texts, "paper long, pos long, text string")
    got = {(x.cited, x.paper, x.pos) for x in R.cite_contexts(r, s).collect()}
    assert got == {(10, 1, 0), (10, 1, 3), (11, 1, 1), (12, 1, 1)}
    wanted = spark.createDataFrame([(1, "Kuang et al", "2023"), (1, "Anderson & Rubin", "1949"), (1, "Nobody", "1949"), (1, "", "1949")], "paper long, name string, year string")
    first = {(x.name, x.year): x.pos for x in R.governor_cites(wanted, r.withColumnRenamed("cited", "pos")).collect()}
    assert first == {("Kuang et al", "2023"): 12, ("Anderson & Rubin", "1949"): 10}


def test_names_in_texts(spark):
    rows = [("We use C4.", "C4", True), ("We use c4.", "C4", False), ("a XC4 b", "C4", False), ("on CIFAR 10 data", "CIFAR-10", True), ("nothing", "CIFAR-10", False), ("x", "", False), ("a.b", "a.b", True), ("axb", "a.b", False)]
    got = spark.createDataFrame(rows, "t string, n string, want boolean").select("want", R.names_in(F.col("t"), F.col("n")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_landed_pages(spark):
    oai = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords><record><header><identifier>oai:arXiv.org:1</identifier><datestamp>2025-09-01</datestamp></header><metadata><x xmlns="http://purl.org/dc/elements/1.1/"><title> A\n title </title><date>2024-01-01</date></x></metadata></record><record><header status="deleted"><identifier>oai:x:2</identifier></header></record></ListRecords></OAI-PMH>'
    got = R.oai_records(spark.createDataFrame([("p", oai), ("q", None)], "page string, xml string")).collect()
    assert [tuple(r) for r in got] == [("p", "1", "A title", "2024-01-01", "2025-09-01", None)]
    with pytest.raises(Exception, match="ParseError|not well-formed|syntax error|no element"):
        R.oai_records(spark.createDataFrame([("p", "<a>")], "page string, xml string")).collect()
    html = 'x<div class="section"><h2>Front</h2><div class="obj_article_summary"><a href="article/view/1">No</a></div></div><div class="section"><h2> AAAI Special Track\n on Y </h2><div class="obj_article_summary"><a href="article/view/22" id="x"> <b>Yes</b> it </a><div class="authors"> A, B ,</div></div><div class="obj_article_summary"><a href="article/view/23">Alone</a></div></div>'
    got = R.issue_articles(spark.createDataFrame([(7, html), (8, None)], "issue long, html string")).collect()
    assert [(r.id, r.title, list(r.authors), r.section) for r in got] == [("22", "Yes it", ["A", "B"], "AAAI Special Track on Y"), ("23", "Alone", [], "AAAI Special Track on Y")]


def test_bibliographies_with_names_joins_and_faults(tmp_path, spark):
    from lumenlit.sources import files as Fi

    text = """% note @ here
@string{icml = "Int. Conf."}
@comment{ignored {x} @misc{no, a={b}}}
@InProceedings(k1, booktitle = icml # " on " # {ML}, title = {A \\} brace {N}}, year = 2024,)
@misc{broken, title = {never closed
@article{k2, title="Q {"}uote", note = {}}
@misc{k3}"""
    got = Fi.parse_bibtex(text)
    assert [e["key"] for e in got] == ["k1", "k2", "k3"]
    assert got[0] == {"kind": "inproceedings", "key": "k1", "booktitle": "Int. Conf. on ML", "title": "A \\ brace N", "year": "2024"}
    assert got[1]["title"] == 'Q "uote' and got[1]["note"] == "" and Fi.parse_bibtex("") == [] and Fi.parse_bibtex("@") == []
    (tmp_path / "a.bib").write_text(text)
    (tmp_path / "b.bib").write_text("")
    rows = Fi.read_bibtex(spark, f"file://{tmp_path}/*.bib").collect()
    assert sorted((r.file, r.key) for r in rows) == [("a.bib", "k1"), ("a.bib", "k2"), ("a.bib", "k3")]
    Fi.dump_json(f"{tmp_path}/x/y.json", {"ü": [1]})
    assert (tmp_path / "x" / "y.json").read_text(encoding="utf-8") == '{\n  "ü": [\n    1\n  ]\n}' and len(list((tmp_path / "x").iterdir())) == 1
