"""Extraction and storage questions that go through files or Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenlit.operators.shared import shared_folder
from lumenlit.plans.registry import query
from lumenlit.sources import files as Fi
from lumenlit.sources import html as H


def _folder(b) -> str:
    return f"{shared_folder(b.spark)}/files-{uuid.uuid4().hex}"


@query("S01 S02 S03", "", "SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS bal FROM customer")
def jsonl_round_trip(b):
    path = _folder(b)
    Fi.write_jsonl(b.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("bal")), path)
    return Fi.read_jsonl(b.spark, path, "id long, name string, bal double")


@query("S25", "", "SELECT p_partkey AS id, p_name AS name FROM part")
def csv_round_trip(b):
    path = _folder(b)
    Fi.write_csv(b.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), path)
    return b.spark.read.option("header", True).schema("id long, name string").csv(path)


@query("S13 S14 S26", "", "SELECT p_name AS author, p_size::VARCHAR AS year, count(*) AS n FROM part GROUP BY ALL")
def bibtex_round_trip(b):
    path = _folder(b)
    lines = Fi.bibtex_lines(b.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("author"), F.col("p_size").alias("year"), F.col("p_brand").alias("title")))
    lines.select("bibtex").write.text(path)
    e = Fi.read_bibtex(b.spark, path)
    return e.groupBy(F.col("fields")["author"].alias("author"), F.col("fields")["year"].alias("year")).agg(F.count("*").alias("n"))


@query("S05 S06 S07 S08 S09 S27 D16 D17", "obs uses", "SELECT edition, count(*) AS uses, sum(n_evidence)::BIGINT AS evidence FROM uses JOIN obs USING (obs_id) GROUP BY 1")
def revision_round_trip(b):
    """Publish a checked revision, read it back by its id, nest and unnest."""
    path = _folder(b)
    tables = {"observations": b.observations(), "uses": b.uses(), "benchmarks": b.benchmarks()}
    rev = Fi.write_revision(tables, path, {"observations": ["obs_id"], "uses": ["obs_id", "benchmark_id", "role"], "benchmarks": ["id"]}, [("uses", "obs_id", "observations", "obs_id"), ("uses", "benchmark_id", "benchmarks", "id")])
    o, u = b.spark.read.parquet(f"{path}/{rev}/observations"), b.spark.read.parquet(f"{path}/{rev}/uses")
    flat = Fi.unnest(Fi.nest(o, u))
    return flat.join(o.select("obs_id", "edition"), "obs_id").groupBy("edition").agg(F.count("*").alias("uses"), F.sum("n_evidence").alias("evidence"))


@query("S15", "", "SELECT DISTINCT p_partkey AS id, p_name AS name FROM part")
def distinct_feed(b):
    p = b.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return Fi.distinct_ids(p.union(p.filter("id % 10 = 0")), "id", "name")


@query("E01 S18 D30")
def page_sections(b):
    """Headings, paragraphs and links of whole pages, by an HTML parser."""
    return H.parse_pages(b.table("pages"), "page_id", "html")
