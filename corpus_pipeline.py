"""The corpus pipeline: documents in, encoded documents out.

Each stage works on all that its predecessor kept, and all but the last return
the columns of documents. The near-duplicate stage decides by row, so null and
repeated ids are rows as any other.

Cases: null texts and texts without a letter have no language and go with the
first stage, as all do if no row has a label; an empty table stays empty through
all stages; of equal rows of one group the first number stays; very long texts
are read and encoded whole, in pieces; extra columns, whatever their names, are
left behind by the first stage; null sources and languages are sources and
languages of their own in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.llm.bpe import bpe_encode
from lumenlit.llm.crf import identify_languages
from lumenlit.llm.jaccard_join import jaccard_join
from lumenlit.llm.mixing import mix_to_targets
from lumenlit.llm.queries import tokenizer_file
from lumenlit.llm.store import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose words agree on no language: the best one has less than this.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that its words agree on; ``lang`` becomes the
    one found. The field is fitted on the stage's own labelled rows."""
    found = identify_languages(docs, keep=COLUMNS[1:])
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest id, null ids last.
    Rows are told apart by a number written with the stage's input."""
    rows = materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    joined = jaccard_join(rows, id_col="row").filter("copies > 1 or n_links > 0").select(F.col("doc_id").alias("row"), "class_id")
    grouped = materialise(joined.join(rows.select("row", "doc_id"), "row"), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = grouped.groupBy("class_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    drop = materialise(grouped.select("row").join(kept, "row", "left_anti"), "dropped")
    if drop.count() <= 500_000:  # 8 bytes a row
        drop = F.broadcast(drop)
    return rows.join(drop, "row", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens match the target weights."""
    return mix_to_targets(docs).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of these and of what they decode
    to."""
    import public_tokenizers

    return bpe_encode(docs, tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("encoding", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
