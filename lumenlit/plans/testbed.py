"""Stand-in relations over the synthetic star-schema tables.

The tables are not literature data. They are read under these names so that
every operator has something of the right shape to run on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Bed:
    spark: SparkSession
    dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def observations(self) -> DataFrame:
        venue = F.lower(F.expr("substr(o_orderpriority, 3)"))
        year = F.year("o_orderdate").cast("long")
        return self.table("orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_custkey").alias("paper_id"), venue.alias("venue"), year.alias("year"), F.concat_ws("-", venue, year).alias("edition"))

    def uses(self) -> DataFrame:
        role = F.when(F.col("l_linestatus") == "O", "evaluates_on").otherwise("trains_on")
        rows = self.table("lineitem").select(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("benchmark_id"), role.alias("role"), F.col("l_quantity").cast("long").alias("q"))
        return rows.groupBy("obs_id", "benchmark_id", "role").agg(F.count("*").alias("n_evidence"), F.sum("q").alias("surface"))

    def evidence(self) -> DataFrame:
        role = F.when(F.col("l_linestatus") == "O", "evaluates_on").otherwise("trains_on")
        return self.table("lineitem").select(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("benchmark_id"), role.alias("role"), F.col("l_linenumber").cast("long").alias("ord"), F.col("l_suppkey").alias("place"))

    def benchmarks(self) -> DataFrame:
        kind = F.when(F.regexp_extract("p_type", r"^(\w+)", 1).isin("STANDARD", "ECONOMY", "MEDIUM"), "benchmark").otherwise("dataset")
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_brand").alias("brand"))

    def labels(self) -> DataFrame:
        """Field labels of observations with their origins."""
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        who = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        flat = who.select(F.col("c_custkey").alias("paper_id"), F.explode(F.array(F.struct(F.col("c_mktsegment").alias("label"), F.lit("declared_area").alias("origin")), F.struct(F.col("n_name").alias("label"), F.lit("declared_subarea").alias("origin")), F.struct(F.col("r_name").alias("label"), F.lit("derived_topic").alias("origin")))).alias("l"))
        return flat.select("paper_id", "l.*")

    def claims(self) -> DataFrame:
        """First edition in which an entry was introduced, as (year, edition)."""
        rows = self.table("lineitem").filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("obs_id"), F.col("l_partkey").alias("benchmark_id"))
        return rows.join(self.observations(), "obs_id").groupBy("benchmark_id").agg(F.min(F.struct("year", "edition")).alias("c")).select("benchmark_id", F.col("c.year").alias("claim_year"), F.col("c.edition").alias("claim_edition"))

    def documents(self) -> DataFrame:
        return self.table("documents")


#: The same relations for the SQL twins.
SQL = {
    "obs": "obs AS (SELECT o_orderkey AS obs_id, o_custkey AS paper_id, lower(substr(o_orderpriority, 3)) AS venue, year(o_orderdate)::BIGINT AS year, lower(substr(o_orderpriority, 3)) || '-' || year(o_orderdate) AS edition FROM orders)",
    "uses": "uses AS (SELECT l_orderkey AS obs_id, l_partkey AS benchmark_id, CASE WHEN l_linestatus = 'O' THEN 'evaluates_on' ELSE 'trains_on' END AS role, count(*) AS n_evidence, sum(l_quantity::BIGINT)::BIGINT AS surface FROM lineitem GROUP BY ALL)",
    "evidence": "evidence AS (SELECT l_orderkey AS obs_id, l_partkey AS benchmark_id, CASE WHEN l_linestatus = 'O' THEN 'evaluates_on' ELSE 'trains_on' END AS role, l_linenumber::BIGINT AS ord, l_suppkey AS place FROM lineitem)",
    "bench": "bench AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN regexp_extract(p_type, '^(\\w+)', 1) IN ('STANDARD', 'ECONOMY', 'MEDIUM') THEN 'benchmark' ELSE 'dataset' END AS kind, p_brand AS brand FROM part)",
    "labels": "labels0 AS (SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), olabels AS (SELECT c_custkey AS paper_id, c_mktsegment AS label, 'declared_area' AS origin FROM labels0 UNION ALL SELECT c_custkey, n_name, 'declared_subarea' FROM labels0 UNION ALL SELECT c_custkey, r_name, 'derived_topic' FROM labels0)",
    "latest": "latest AS (SELECT venue, max(edition) AS edition FROM obs GROUP BY venue), scope AS (SELECT o.* FROM obs o JOIN latest l ON o.venue = l.venue AND o.edition = l.edition)",
    "claims": "claims AS (SELECT benchmark_id, min((year, edition))[1] AS claim_year, min((year, edition))[2] AS claim_edition FROM (SELECT l_partkey AS benchmark_id, o.year, o.edition FROM lineitem JOIN obs o ON o.obs_id = l_orderkey WHERE l_returnflag = 'N') GROUP BY 1)",
    "fold": "",
}


def sql(parts: str, body: str) -> str:
    """A twin: the named relations, then the body (which may go on with more)."""
    return "WITH " + ", ".join(SQL[p] for p in parts.split()) + (" " if body.lstrip().upper().startswith("SELECT") else ", ") + body
