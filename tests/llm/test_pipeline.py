import hashlib
import random
import subprocess
import sys

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lumenlit.llm.bpe import read_ranks
from lumenlit.llm.mixing import mixing_sql

from test_texts import KIND, WORDS, brute_groups, duck


def make(spark, n=200):
    r = random.Random(8)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choices(WORDS[lang].split(), k=r.randint(10, 60))), lang, r.choice(["big", "big", "s1", None])))
    rows += [(1000 + i, rows[i][1] + (" light" if i % 2 else ""), rows[i][2], "big") for i in range(30)]
    rows += [(2000, None, "en", "s1"), (2001, "", None, None), (2002, "12 34 --", "de", "s1"), (None, "the house and the light of water walking green thing the house", None, None)]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], KIND), rows


def test_stages(spark):
    docs, rows = make(spark)
    first = corpus_pipeline.language(spark, docs, "")
    assert first.columns == docs.columns
    kept = {r.doc_id: r for r in first.collect()}
    assert set(kept) == {r[0] for r in rows} - {2000, 2001, 2002}
    assert sum(kept[r[0]].lang == r[2] for r in rows if r[0] in kept and r[2]) >= 0.97 * len(kept)
    first = spark.createDataFrame(list(kept.values()), KIND)

    second = corpus_pipeline.near_duplicates(spark, first, "")
    assert second.columns == docs.columns
    groups = brute_groups([(i, kept[i].text) for i in kept])
    want = {i for i, _, c in groups if i is None or i == c}
    assert {r.doc_id for r in second.collect()} == want

    third = corpus_pipeline.mixing(spark, second, "")
    assert third.columns == docs.columns
    assert {r.doc_id for r in third.collect()} == {r[0] for r in duck(second, mixing_sql())}

    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in third.collect()}
    last = corpus_pipeline.encoding(spark, third, "").collect()
    assert {r.doc_id for r in last} == set(texts)
    for r in last:
        assert r.ids == tik.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_near_duplicates_decide_by_row(spark):
    r = random.Random(6)
    a, b, c, d = (" ".join(f"{x}{r.randrange(1000)}" for _ in range(40)) for x in "abcd")
    rows = [(None, a), (None, a), (7, b), (7, b), (3, c), (5, c), (5, d), (None, d + " more"), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted([(None, a), (7, b), (3, c), (5, d), (9, None), (9, None)], key=str)


def test_run_and_empty_tables(spark, tmp_path):
    docs, _ = make(spark, 60)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    docs.withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/c").count() == 0  # no label, no language


def test_entry_without_the_subpackage(tmp_path):
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(f"{root}/lumenlit", tmp_path / "lumenlit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    for more in (False, True):  # with the pipeline's file still there, and without
        if more:
            shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert e.oracle_sql()"
        assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}).returncode == 0
