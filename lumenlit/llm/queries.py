"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.llm.store import shared_dir, table


def tokenizer_file(name: str) -> str:
    """Vocabulary files come with a package of public tokenizers; they are read
    where it keeps them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlit.llm.token_store import token_store

    return token_store(spark, table(spark, sf_dir, "documents"), shared_dir(spark, "tokens"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlit.llm.jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlit.llm.licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents")).drop("places")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlit.llm.mixing import mix_to_targets

    return mix_to_targets(table(spark, sf_dir, "documents"), details=True)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lumenlit.llm.bpe import bpe_encode

    return bpe_encode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlit.llm.images import image_copies, render_vectors

    return image_copies(render_vectors(table(spark, sf_dir, "embeddings")))


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlit.llm.crf import identify_languages

    def held_out(doc_id):
        return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0

    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, learn=~held_out(F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlit.llm.vector_graph import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlit.llm.suffix_tree import suffix_tree_scores

    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    scored = suffix_tree_scores(table(spark, sf_dir, "documents"), learn=~held_out)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenlit.llm.warc import warc_roundtrip

    back = warc_roundtrip(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_licence_scan": op3_licence_scan,
        "op4_source_mixing": op4_source_mixing,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_image_copies": op6_image_copies,
        "op7_language_crf": op7_language_crf,
        "op8_vector_graph": op8_vector_graph,
        "op9_suffix_tree": op9_suffix_tree,
        "op10_warc": op10_warc,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs of texts by the shingles that they share.
JACCARD_SQL = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(1))] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(1))) END)) AS s FROM w),
x AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN s q ON q.doc_id = a JOIN s r ON r.doc_id = b WHERE c >= 0.8 * (len(q.s) + len(r.s) - c) - 1e-9),
reach AS (SELECT a AS n, a AS m FROM l UNION SELECT reach.n, l.b FROM reach JOIN l ON l.a = reach.m),
c AS (SELECT n, min(m) AS class_id FROM reach GROUP BY 1), k AS (SELECT a AS n, count(*) AS k FROM l GROUP BY 1), e AS (SELECT s, count(*) AS e FROM s GROUP BY 1)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN 1 ELSE e.e END::BIGINT AS copies, coalesce(k.k, 0)::BIGINT AS n_links, coalesce(c.class_id, doc_id) AS class_id, coalesce(c.class_id, doc_id) = doc_id AS kept
FROM s JOIN e ON e.s = s.s LEFT JOIN c ON c.n = doc_id LEFT JOIN k ON k.n = doc_id"""

#: All pairs of vectors of a label.
VECTOR_SQL = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS n, a AS m FROM l UNION SELECT reach.n, l.b FROM reach JOIN l ON l.a = reach.m),
c AS (SELECT n, min(m) AS c FROM reach GROUP BY 1), k AS (SELECT a AS n, count(*) AS k FROM l GROUP BY 1)
SELECT vec_id, coalesce(k.k, 0)::BIGINT AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON c.n = vec_id LEFT JOIN k ON k.n = vec_id"""

_BITS = "CASE c " + " ".join(f"WHEN '{x:x}' THEN '{x:04b}'" for x in range(16)) + " END"
_FIVE = " + ".join(f"{1 << (4 - k)} * (substr(bits, 5 * i::INT + {k + 1}, 1) = '1')::INT" for k in range(5))

#: Digests of whole payloads, in base 32 by way of their bits.
WARC_SQL = f"""WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS s FROM pages),
b AS (SELECT *, array_to_string(list_transform(string_split(s, ''), lambda c: {_BITS}), '') AS bits FROM d),
f AS (SELECT s, min(page_id) AS first FROM d GROUP BY 1)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b JOIN f USING (s)"""


def oracle_sql() -> dict[str, str]:
    from lumenlit.llm.licences import licence_sql
    from lumenlit.llm.mixing import mixing_sql

    return {"op2_jaccard_join": JACCARD_SQL, "op3_licence_scan": licence_sql(), "op4_source_mixing": mixing_sql(), "op8_vector_graph": VECTOR_SQL, "op10_warc": WARC_SQL}
