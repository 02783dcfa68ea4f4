"""Queries of the subpackage against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lumenlit.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    place = [want.columns.index(n) for n in names]
    left = sorted((tuple(r[n] for n in names) for r in got.collect()), key=str)
    right = sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)
    assert left == right and left


def test_columns_of_clashing_names(spark):
    """Extra columns, whatever their names, change nothing."""
    from pyspark.sql import functions as F

    from lumenlit.llm.bpe import bpe_encode
    from lumenlit.llm.images import image_copies, render_vectors
    from lumenlit.llm.suffix_tree import suffix_tree_scores
    from lumenlit.llm.vector_graph import near_duplicate_vectors
    from lumenlit.llm.queries import tokenizer_file

    def extra(df, *names):
        return df.withColumns({n: F.lit(n) for n in names})

    docs = spark.createDataFrame([(i, "the cat sat on the mat " * (i % 5)) for i in range(60)] + [(60, "word " * 200_000), (61, None)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float((i * k) % 7 + 1) for k in range(16)], i % 2) for i in range(30)], "vec_id long, embedding array<double>, label int")
    rows = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    import public_tokenizers as P

    encode = lambda df: bpe_encode(df, tokenizer_file("byte_bpe_50k.tiktoken"), P.PATTERN, ids=False)
    assert rows(encode(docs)) == rows(encode(extra(docs, "ids", "n_tokens", "ids_sha256")))
    assert rows(suffix_tree_scores(docs, min_symbol=2, min_context=4)) == rows(suffix_tree_scores(extra(docs, "id", "learn", "chunk", "bucket"), min_symbol=2, min_context=4))
    assert rows(near_duplicate_vectors(vectors)) == rows(near_duplicate_vectors(extra(vectors, "id", "cell", "unit", "key", "first")))
    assert rows(image_copies(render_vectors(vectors), tables=2)) == rows(image_copies(extra(render_vectors(extra(vectors, "image", "v")), "id", "key", "points", "a", "b"), tables=2))
