"""Fixtures re-typed as rows, with the figures they must give."""

import pytest
from pyspark.sql import functions as F

from lumenlit.functions import stats as St
from lumenlit.functions import text as X
from lumenlit.operators import match as M
from lumenlit.operators import usage as U
from lumenlit.operators.graph import connected
from lumenlit.operators.scope import Scope, ScopeError, find_entity
from lumenlit.sources import files as Fi
from lumenlit.sources.html import parse_page

PAPERS = [(i, f"24.{i}", "icml", 2024) for i in range(1, 5)] + [(10 + i, f"25.{i}", "icml", 2025) for i in range(1, 8)]


@pytest.fixture(scope="module")
def world(spark):
    obs = spark.createDataFrame(PAPERS, "obs_id long, paper_id string, venue string, year long").withColumn("edition", F.concat_ws("-", "venue", F.col("year").cast("string")))
    uses = spark.createDataFrame([(1, 7, "evaluates_on", 1), (2, 8, "evaluates_on", 1), (4, 9, "evaluates_on", 2), (11, 9, "evaluates_on", 1), (12, 9, "evaluates_on", 1), (12, 9, "trains_on", 1), (13, 9, "evaluates_on", 1), (14, 9, "evaluates_on", 1), (15, 7, "evaluates_on", 1)], "obs_id long, benchmark_id long, role string, n_evidence long")
    return obs, uses


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_usage_of_the_latest_edition(world):
    obs, uses = world
    rows = U.usage(Scope(latest=True).apply(obs), uses).collect()
    assert (rows[0].benchmark_id, rows[0].papers, rows[0].parsed_papers, rows[0].share_percent, rows[0].per_1000) == (9, 4, 7, 57.1, 571.429)
    assert U.usage(Scope(latest=True).apply(obs), uses, "trains_on").first().papers == 1
    assert U.usage(Scope(years=[2024], latest=True).apply(obs), uses).count() == 3


def test_trend_has_zeros_and_shares(world):
    obs, uses = world
    rows = {r.edition: r for r in U.trend(obs, uses, 7).collect()}
    assert (rows["icml-2024"].share_percent, rows["icml-2025"].share_percent) == (25.0, 14.3)
    assert rows["icml-2025"].state == "no_detected_change" and rows["icml-2024"].state is None
    assert {r.edition: r.k for r in U.trend(obs, uses, 8).collect()} == {"icml-2024": 1, "icml-2025": 0}


def test_adoption_counts_papers(world, spark):
    obs, uses = world
    groups = spark.createDataFrame([(9, "25.1", "self"), (9, "25.2", "others"), (9, "25.3", "self"), (9, "24.4", "others")], "benchmark_id long, paper_id string, who string")
    claims = spark.createDataFrame([(9, 2025)], "benchmark_id long, claim_year long")
    r = U.adoption(obs, uses, groups, claims).first()
    assert (r.evaluates_on_others, r.evaluates_on_self, r.evaluates_on_undetermined, r.trains_on_others, r.before_claim) == (2, 2, 1, 1, 1)


def test_scopes(world, spark):
    obs, _ = world
    labels = spark.createDataFrame([("25.1", "Vision")], "paper_id string, label string")
    assert Scope(papers=[]).apply(obs).count() == 0 and Scope(papers=["25.1"]).apply(obs).count() == 1
    assert Scope(topic="vision").checked(obs, labels).count() == 1
    for bad in (Scope(topic="none"), Scope(venue="nips"), Scope(edition="icml-1999")):
        with pytest.raises(ScopeError):
            bad.checked(obs, labels)
    entries = spark.createDataFrame([(1, "Toy"), (2, "The Mirage benchmark"), (3, "Mirage")], "id long, name string")
    assert find_entity(entries, X.fold, "toy dataset").first().id == 1 and find_entity(entries, X.fold, "3").first().id == 3
    for bad in ("mirage", "nothing"):
        with pytest.raises(ScopeError):
            find_entity(entries, X.fold, bad)


def test_scalars(spark):
    assert one(spark, St.percentage(F.lit(1), F.lit(16))) == 6.3 and one(spark, St.percentage(F.lit(1), F.lit(0))) is None
    assert abs(one(spark, St.p_value(F.lit(1.959964))) - 0.05) < 1e-6
    assert one(spark, St.trend_state(F.lit(0), F.lit(100), F.lit(8), F.lit(100))) == "appearing"
    assert one(spark, St.trend_state(F.lit(10), F.lit(3059), F.lit(90), F.lit(4252))) == "rising"
    assert one(spark, St.trend_state(F.lit(1), F.lit(0), F.lit(8), F.lit(100))) == "insufficient_scope"
    assert one(spark, X.fold(F.lit("The τ²-Bench Dataset"))) == "tau2bench"
    assert one(spark, X.title_tokens(F.lit("Towards the Best of Big Nets, based for Nets"))) == ["towards", "best", "big", "nets"]
    assert one(spark, X.bigrams(F.array(F.lit("a")))) == [] and one(spark, X.bigrams(X.words(F.lit("a b c")))) == ["a b", "b c"]
    assert one(spark, X.url_kind(F.lit("https://www.huggingface.co/datasets/x"))) == "dataset" and one(spark, X.url_kind(F.lit("http://github.com/a/b"))) == "code"
    assert one(spark, X.sentences(F.lit("One. two! Three (x). (Four)"))) == ["One. two!", "Three (x).", "(Four)"]


def test_titles(spark):
    left = spark.createDataFrame([(1, "Graph Nets: a deep study of learning"), (2, "Nothing like it")], "id long, title string")
    right = spark.createDataFrame([(7, "graph nets a deep study of learning"), (8, "Graph nets, another deep study of learning")], "id long, title string")
    assert [tuple(r) for r in M.exact_titles(left, right).collect()] == [(1, 7)]
    r = M.fuzzy_titles(left, right, 0.7).collect()
    assert [(x.id, x.match_id, x.kind) for x in r] == [(1, 7, "exact")]
    assert M.contained_passages(spark.createDataFrame([(1, "A passage long enough to count"), (2, "short")], "id long, text string"), spark.createDataFrame([(5, "so a PASSAGE, long enough to count!"), (6, "a passage long enough to counting")], "id long, text string")).collect()[0][:] == (1, 5)


def test_components(spark):
    got = {tuple(r) for r in connected(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60)], "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(21)} | {(50, 50), (60, 50)}


def test_bibtex():
    e = Fi.parse_bibtex("@inproceedings{k1, title = {A {Nested} Title},\n author=\"B C\", year = 2024}\n@misc{k2, note={x}}")
    assert e == [{"kind": "inproceedings", "key": "k1", "title": "A Nested Title", "author": "B C", "year": "2024"}, {"kind": "misc", "key": "k2", "note": "x"}]


def test_revisions(spark, tmp_path):
    t = {"a": spark.createDataFrame([(1, "x"), (2, None)], "id long, v string"), "b": spark.createDataFrame([(1,)], "a_id long")}
    keys, refs = {"a": ["id"]}, [("b", "a_id", "a", "id")]
    rev = Fi.write_revision(t, f"file://{tmp_path}", keys, refs)
    turned = dict(t, a=t["a"].orderBy(F.desc("id")))
    assert Fi.write_revision(turned, f"file://{tmp_path}", keys, refs) == rev
    assert spark.read.parquet(f"file://{tmp_path}/{rev}/a").count() == 2
    with pytest.raises(ValueError):
        Fi.write_revision(dict(t, b=spark.createDataFrame([(9,)], "a_id long")), f"file://{tmp_path}", keys, refs)
    with pytest.raises(ValueError):
        Fi.write_revision(dict(t, a=t["a"].union(t["a"])), f"file://{tmp_path}", keys, refs)


def test_pages():
    p = parse_page('<title>T</title><script>var t="</p>";</script><h1>H</h1><p>one<p>two <a href="/x">l</a><h2>K</h2>z')
    assert p == {"title": "T", "links": 1, "sections": [{"level": "h1", "heading": "H", "text": "one two l"}, {"level": "h2", "heading": "K", "text": "z"}]}
    assert parse_page(None) == {"title": "", "links": 0, "sections": []}
