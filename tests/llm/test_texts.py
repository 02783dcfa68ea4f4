import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlit.llm.crf import Crf, fit, identify_languages, split_words
from lumenlit.llm import jaccard_join as jaccard_module
from lumenlit.llm.components import forest
from lumenlit.llm.jaccard_join import _parts, candidate_edges, could_link, jaccard_join, shingle_sets
from lumenlit.llm.licences import TEMPLATES, licence_sql, scan_licences
from lumenlit.llm.mixing import mix_to_targets, mixing_sql
from lumenlit.llm.suffix_tree import suffix_tree_scores

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *(more + ["en", "s", 0][len(more) :])) for i, t, *more in rows], KIND)


def duck(df, sql):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    got = con.sql(sql).fetchall()
    return sorted(got, key=str)


def spark_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


LICENCES = ["", None, "All rights reserved. CC BY", "cc-by cc by CC  BY", "the GNU General Public License, version 3", "general public licenses", "Licensed under the Apache License, Version 2.0.", "écc by", "all rights\nreserved all rights reserved", "CC BY-NC 4.0", "x " * 30000 + "cc by", "Permission is hereby granted, free of charge, to any person obtaining a copy", "ccby c c by", "_cc_by_"]


def test_licences_equal_trying_every_place(spark):
    df = docs(spark, [(i, t) for i, t in enumerate(LICENCES)] + [(2, LICENCES[2]), (None, "cc by")])
    got = scan_licences(df.withColumn("words", F.lit(1)).withColumn("score", F.lit(2))).drop("places")
    assert spark_rows(got) == duck(df, licence_sql())
    assert not scan_licences(df.limit(0)).collect()
    by_id = {r.doc_id: r for r in scan_licences(df).collect()}
    assert by_id[3].n_base == 3 and by_id[10].first_word == 30000 and by_id[5].labels == ""
    assert "gpl-3.0" in by_id[4].labels and "cc-by-nc" in by_id[9].labels and by_id[6].score == 1.0
    assert {t.label for t in TEMPLATES if t.base} == {"cc-by", "gpl", "reserved"}


def mixed(n=400):
    r = random.Random(5)
    return [(i, " ".join(["word"] * r.randint(0, 120)) + r.choice(["", " | x", "***"]), r.choice(["en", "en", "en", "de", None]), r.choice(["big"] * 6 + ["a", "b", None])) for i in range(n)]


def test_mixing_equals_sql_and_hits_targets(spark):
    df = docs(spark, mixed())
    got = mix_to_targets(df, details=True)
    assert spark_rows(got) == duck(df, mixing_sql())
    kept = mix_to_targets(df.withColumn("a", F.lit(1)).withColumn("prob", F.lit("x")).withColumn("s", F.lit("y")))
    assert kept.columns == df.columns + ["a", "prob", "s"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.collect()}
    assert not mix_to_targets(df.limit(0)).collect()
    empty = docs(spark, [(1, None, None, None), (None, "", None, None)])
    assert mix_to_targets(empty).count() == 2


def brute_groups(rows, least=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            u = len(sets[a] & sets[b])
            if sets[a] and sets[b] and u >= least * (len(sets[a]) + len(sets[b]) - u) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        g = find(k)
        if i is not None:
            smallest[g] = min(smallest.get(g, i), i)
    return sorted(((i, links[k], smallest.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("options", [{}, {"bucket": 4, "block": 4, "depth": 2}])
def test_jaccard_join_equals_brute_force(spark, options):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, passage = [], " ".join(r.choices(vocabulary, k=30))
    for g in range(12):
        base = r.choices(vocabulary, k=r.choice([3, 8, 60, 200]))
        for _ in range(r.choice([1, 2, 9])):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows) * 3, " ".join(w) + (" " + passage if g % 3 == 0 else "")))
    rows += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "One two"), (1004, "one TWO"), (None, rows[0][1]), (None, "lonely text without an id at all"), (0, rows[0][1]), (2000, " ".join(vocabulary * 40))]
    got = jaccard_join(spark.createDataFrame([(i, t, b"clash") for i, t in rows], "doc_id long, text string, key binary"), **options)
    assert sorted(((x.doc_id, x.n_links, x.class_id) for x in got.collect()), key=str) == brute_groups(rows)
    assert not jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect()


def test_a_large_bucket_of_near_copies_loses_no_candidate(spark):
    rng, T = np.random.default_rng(5), 64
    base = rng.integers(1, 1 << 32, T, dtype=np.uint32)
    sketches = [base]

    def fresh(x, bins):
        out = x.copy()
        out[bins] = rng.integers(1, 1 << 32, len(bins), dtype=np.uint32)
        return out

    for _ in range(120):  # 58 bins or more like the pivot's: they leave
        sketches.append(fresh(base, rng.choice(np.arange(1, T), rng.integers(1, 7), replace=False)))
    for x in sketches[1:40]:  # most share 39 or more bins with one that leaves, and fewer with the pivot
        kept = np.flatnonzero(x != base)
        others = np.setdiff1d(np.arange(1, T), kept)
        sketches.append(fresh(x, rng.choice(others, 25, replace=False)))
    sketches += [np.append(base[:1], rng.integers(1, 1 << 32, T - 1, dtype=np.uint32)) for _ in range(20)]
    keys = [bytes([0, i // 256, i % 256]) for i in range(len(sketches))]
    classes = spark.createDataFrame([(k, 500, x.astype("<u4").tobytes()) for k, x in zip(keys, sketches)], "key binary, n long, sketch binary")
    found = candidate_edges(classes, 0.8, T, 1, 64, 2).collect()
    s, place = np.array(sketches), {k: i for i, k in enumerate(keys)}
    near = (s[:, None] == s[None]).mean(axis=2) >= 0.6
    assert (near[0] != near[1:121].any(axis=0)).sum() > 5  # pairs that only a leaving class binds
    want = forest(len(s), *np.nonzero(np.triu(near, 1)))
    assert forest(len(s), [place[bytes(r.a)] for r in found], [place[bytes(r.b)] for r in found]) == want


def test_few_and_many_buckets_bind_the_same(spark, monkeypatch):
    rng, T = np.random.default_rng(6), 64
    base = rng.integers(1, 1 << 32, (12, T), dtype=np.uint32).repeat(25, axis=0)
    base[:, :3] = base[0, :3]  # large buckets, split at two levels
    sketches = np.where(rng.random(base.shape) < 0.08, rng.integers(1, 1 << 32, base.shape, dtype=np.uint32), base)
    classes = spark.createDataFrame([(k, 500, x.astype("<u4").tobytes()) for k, x in enumerate(sketches)], "key long, n long, sketch binary")
    made = []
    for few in (10**6, 0):
        monkeypatch.setattr(jaccard_module, "_FEW", few)
        found = candidate_edges(classes, 0.8, T, 3, 20, 2)
        rows = found.collect()
        made.append(forest(len(sketches), [r.a for r in rows], [r.b for r in rows]))
    assert made[0] == made[1] and 12 <= len(set(made[0])) < 100


def test_rows_of_large_buckets_meet_their_pivot_in_one_join(spark, monkeypatch):
    sketches = np.random.default_rng(7).integers(1, 1 << 32, (90, 64), dtype=np.uint32)
    sketches[:, :8] = sketches[0, :8]
    classes = spark.createDataFrame([(k, 500, x.astype("<u4").tobytes()) for k, x in enumerate(sketches)], "key long, n long, sketch binary")
    plans, write = [], jaccard_module.materialise

    def seen(df, name):
        if name == "pivots":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(jaccard_module, "materialise", seen)
    assert not candidate_edges(classes, 0.8, 64, 3, 20, 2).collect()
    assert plans and [sum("Join" in x and "path#" in x for x in p.splitlines()) for p in plans] == [1] * len(plans)


def test_sizes_that_cannot_link_bind_nothing(spark):
    for p in range(1, 40):
        for q in range(p, 40):
            best = max(c / (p + q - c) for c in range(p + 1) if c < q)
            assert could_link(p, q, 0.8) == could_link(q, p, 0.8) == (best >= 0.8 - 1e-9)
    sketches = np.random.default_rng(2).integers(1, 1 << 32, (1, 64), dtype=np.uint32).repeat(80, axis=0)
    sketches[:, 1:] += np.arange(80, dtype=np.uint32)[:, None]  # one path for all, no more in common
    # few shingles, so that the estimate alone leaves all of them open
    classes = spark.createDataFrame([(k, k % 4 + 1, x.astype("<u4").tobytes()) for k, x in enumerate(sketches)], "key long, n long, sketch binary")
    for bucket in (20, 100):
        assert not [r for r in candidate_edges(classes, 0.8, 64, 1, bucket, 2).collect() if max(r.a % 4, r.b % 4) < 3]


def test_a_family_falls_into_parts_that_cannot_link(spark):
    r = random.Random(8)
    passage, texts = [r.choice("abcdefgh") * 3 + str(k) for k in range(20)], []
    for g in range(40):  # all share a passage, by half of what they have
        own = [f"g{g}w{k}" for k in range(20)]
        texts += [" ".join(passage + own), " ".join(passage + own + ["end"]), " ".join(passage + own[1:])]
    sets = shingle_sets(pa.array(texts))
    rows = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "id long, shingles binary")
    part = {x.id: x.part for x in _parts(rows, 0.8).collect()}
    assert len(part) == len(texts) and len(set(part.values())) == 40
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert part[i] == part[j] or len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b))


def test_marginals_equal_one_pass():
    rng = np.random.default_rng(1)
    model = Crf(["a", "b", "c"], {}, np.zeros((1, 3)), np.zeros((3, 3)), rng.normal(size=3), rng.normal(size=(3, 3)))
    sizes = np.array([1, 2, 31, 32, 33, 64, 200])
    E = rng.normal(size=(sizes.sum(), 3)) * 3
    got, at = model.marginals(E, sizes), 0
    for n in sizes:
        e, A = np.exp(E[at : at + n]), np.exp(model.trans)
        al, be = [np.exp(model.start) * e[0]], [np.ones(3)]
        for t in range(1, n):
            al.append(al[-1] @ A * e[t])
            al[-1] /= al[-1].sum()
        for t in range(n - 1, 0, -1):
            be.append(A @ (e[t] * be[-1]))
            be[-1] /= be[-1].sum()
        p = np.array(al) * np.array(be[::-1])
        assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True))
        at += n


WORDS = {"en": "the of and house green walking thing water light", "de": "der und straße haus gehen wasser licht nicht schön", "fr": "le et maison où été eau lumière rue très"}


def test_languages(spark):
    r = random.Random(2)
    rows = []
    for i in range(240):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choices(WORDS[lang].split(), k=r.randint(4, 30))), lang if i % 7 else None))
    truth = {i: next(k for k, v in WORDS.items() if t.split()[0] in v.split()) for i, t, _ in rows}
    rows += [(500, None, "en"), (501, "123 --- !", "de"), (502, "", None), (None, "the house", None)]
    df = docs(spark, rows)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = {x.doc_id: x for x in identify_languages(df, learn=~held, spans=True).collect()}
    assert len(got) == 244 and all(0 <= x.score <= 1 for x in got.values())
    unseen = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert unseen and sum(got[i].lang_pred == truth[i] for i in unseen) >= 0.95 * len(unseen)
    assert got[500].lang_pred == got[501].lang_pred == got[502].lang_pred == "und" and got[500].score == 0
    none = identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {x.lang_pred for x in none} == {"und"}
    assert not identify_languages(df.limit(0)).collect()


def test_code_switched_words():
    r = random.Random(4)
    model = fit([(" ".join(r.choices(WORDS[k].split(), k=40)), k) for k in WORDS for _ in range(30)], sequences=800)
    words = split_words("the green house walking " * 5 + "der straße nicht schön " * 5)
    p = model.marginals(model.emissions(words), np.array([len(words)]))
    assert [model.labels[i] for i in p.argmax(axis=1)] == ["en"] * 20 + ["de"] * 20


def test_suffix_tree(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the cat sat", "a dog ran", "The\x0bend\x1c."]) for _ in range(r.randint(0, 30)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "UNSEEN Words\tonly"), (None, "the cat"), (5, rows[5][1])]
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    got = suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string"), learn=~held, docs_per_chunk=64).collect()
    assert len(got) == len(rows)
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None] for _, t in rows]
    learned = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in rows]
    count = Counter(w for t, ok in zip(tokens, learned) if ok for w in t)
    n, v = sum(count.values()), len(count)
    want = defaultdict(list)
    for (i, _), t in zip(rows, tokens):
        want[i].append((len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)))
    for x in got:
        assert any((x.n_tokens, x.n_known, x.train_tokens) == w[:3] and abs(x.base_score - w[3]) < 1e-6 for w in want[x.id])
    unseen = [x for x in got if not x.learned and x.n_tokens > 5]
    assert sum(x.score for x in unseen) > sum(x.base_score for x in unseen) and all(x.score < 0 for x in got)
    assert not suffix_tree_scores(spark.createDataFrame([], "doc_id long, text string")).collect()
    alone = suffix_tree_scores(spark.createDataFrame(rows[:3], "doc_id long, text string"), learn=F.lit(False)).collect()
    assert {x.train_tokens for x in alone} == {0} and {x.n_known for x in alone} == {0}


def brute_tree(docs, learned, min_symbol, min_context, max_depth, weight):
    """log10 probability of each list of words, by dictionaries of contexts."""
    count = Counter(w for t, ok in zip(docs, learned) if ok for w in t)
    ends = sum(learned)
    tails = defaultdict(lambda: [0, 0])
    for w, c in count.items():
        if c < min_symbol:
            tails[w[-2:]][0] += c
            tails[w[-2:]][1] += 1
    rest = [sum(v[j] for v in tails.values() if v[0] < min_symbol) for j in (0, 1)]

    def symbol(w):
        return ("w", w) if count[w] >= min_symbol else ("t", w[-2:]) if tails.get(w[-2:], [0])[0] >= min_symbol else ("r",)

    mass = {("w", w): c for w, c in count.items() if c >= min_symbol} | {("t", e): v[0] for e, v in tails.items() if v[0] >= min_symbol} | {("r",): rest[0], ("e",): ends}
    n = sum(count.values()) + ends
    norm = n + 0.5 * len(mass)
    seqs = [[("s",), *map(symbol, t), ("e",)] for t in docs]
    kept = {}

    def prob(context, nxt):
        for d in range(len(context), 0, -1):
            if context[-d:] in kept:
                nexts, total = kept[context[-d:]]
                return (nexts[nxt] + weight * prob(context[-d + 1 :] if d > 1 else (), nxt)) / (total + weight)
        return (mass[nxt] + 0.5) / norm

    for d in range(1, max_depth + 1):
        nexts = defaultdict(Counter)
        for s, ok in zip(seqs, learned):
            for i in range(d, len(s) if ok else 0):
                nexts[tuple(s[i - d : i])][s[i]] += 1
        for context, own in nexts.items():
            total = sum(own.values())
            if total < min_context or d > 1 and context[1:] not in kept:
                continue
            p = {x: prob(context[1:], x) for x in own}
            q = {x: (c + weight * p[x]) / (total + weight) for x, c in own.items()}
            left = weight / (total + weight)
            gain = total * (sum(q[x] * math.log(q[x] / p[x]) for x in own) + left * (1 - sum(p.values())) * math.log(left))
            if gain > 0.5 * (len(own) - 1) * math.log(total) + math.log(total):
                kept[context] = own, total
    out = []
    for t, s in zip(docs, seqs):
        score = sum(math.log10(prob(tuple(s[max(0, i - max_depth) : i]), s[i])) for i in range(1, len(s)))
        for w in t:
            x = symbol(w)
            if x[0] != "w":
                m, v = tails[w[-2:]] if x[0] == "t" else rest
                score += math.log10((count[w] + 0.5) / (m + 0.5 * (v + 1)))
        out.append(score)
    return out, kept


@pytest.mark.parametrize("hot", [1_000_000, 60])
def test_suffix_tree_equals_brute_force(spark, hot):
    r = random.Random(12)
    names = [f"w{i}" for i in range(6)]
    after = {(x, y, z): r.choice(names) for x in names for y in names for z in names}  # each word follows from three
    rows = []
    for i in range(300):
        t = r.choices(names, k=3)
        for _ in range(r.randint(0, 60)):
            t.append(after[tuple(t[-3:])] if r.random() < 0.8 and all(w in names for w in t[-3:]) else r.choice([*names, *names, f"rare{r.randrange(900)}", "x"]))
        rows.append((i, " ".join(t) if i else None))
    learned = [i % 4 != 0 for i, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.id: x.score for x in suffix_tree_scores(df, learn=F.col("doc_id") % 4 != 0, min_symbol=5, min_context=10, docs_per_chunk=40, hot=hot).collect()}
    want, kept = brute_tree([(t or "").split() for _, t in rows], learned, 5, 10, 3, 20.0)
    assert {len(c) for c in kept} == {1, 2, 3}
    assert all(abs(got[i] - x) < 0.02 + 1e-3 * abs(x) for (i, _), x in zip(rows, want))


def test_words_are_letters():
    assert split_words("² ½ Ⅷ ①x2 a_b") == ["x", "a", "b"]


@pytest.mark.parametrize("n_langs", [5, 100])
def test_long_texts_in_pieces_and_many_languages(spark, n_langs):
    r = random.Random(5)
    words = [["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for _ in range(n_langs)]
    train = [(" ".join(r.choices(words[k], k=30)), f"l{k:03d}") for k in range(n_langs) for _ in range(4)]
    model = fit(train, sequences=40 * n_langs, steps=25)
    text = " ".join(w for _ in range(30) for k in (1, 2, 1) for w in r.choices(words[k], k=40))
    own = split_words(text)
    assert split_words("² ½") == []
    p = model.marginals(model.emissions(own), np.array([len(own)]))
    total, n, top = model.long_text(text, True)
    assert n == len(own) and np.allclose(total, p.sum(axis=0), rtol=1e-6) and (top == p.argmax(axis=1)).mean() > 0.999
    df = docs(spark, [(i, t, None) for i, (t, _) in enumerate(train)] + [(9000, text, None), (9001, "² ½", None), (9002, text, None)])
    whole = {x.doc_id: x for x in identify_languages(df, model=model, spans=True).collect()}
    cut = {x.doc_id: x for x in identify_languages(df.withColumn("score", F.lit("clash")).withColumn("h", F.lit(1)), model=model, spans=True, long_text=2000).collect()}
    assert whole[9001].lang_pred == cut[9001].lang_pred == "und" and whole[9000].lang_pred == "l001"
    assert all(abs(whole[i].score - cut[i].score) < 1e-6 and whole[i].spans == cut[i].spans and whole[i].lang_pred == cut[i].lang_pred for i in whole)
    assert sum(whole[i].lang_pred == label for i, (_, label) in enumerate(train)) >= 0.97 * len(train)


def test_mixing_beyond_the_pairs_kept_by_the_driver(spark):
    df = docs(spark, mixed())
    assert spark_rows(mix_to_targets(df, details=True, max_pairs=2, sweeps=3)) == duck(df, mixing_sql(sweeps=3))
    r = random.Random(3)
    many = docs(spark, [(i, "word " * r.randint(1, 9), f"lang{i % 5000}", f"s{i % 7}") for i in range(9000)])
    got = mix_to_targets(many, details=True, sweeps=1)
    assert spark_rows(got) == duck(many, mixing_sql(sweeps=1))


def test_mixing_meets_its_margins(spark):
    df = docs(spark, mixed(6000))
    cells = defaultdict(float)
    for _, t, lang, source in mixed(6000):
        n = len(t.split())
        topic = "table" if " | " in t else "marked" if "***" in t else "note" if n < 40 else "prose"
        cells[source or "", lang or "", topic] += n
    total = sum(cells.values())
    kept = {(x.source, x.lang, x.topic): x.prob for x in mix_to_targets(df, details=True, share=0.3).collect()}  # low: no probability is capped
    for k, power in enumerate((0.7, 0.7, 0.9)):
        sums, reached = defaultdict(float), defaultdict(float)
        for cell, n in cells.items():
            sums[cell[k]] += n
            reached[cell[k]] += n * kept.get(cell, 0.0)
        scale = sum(v**power for v in sums.values())
        for x, v in sums.items():
            assert abs(reached[x] / (0.3 * total) / (v**power / scale) - 1) < 0.02


def test_recall_below_the_first_level(spark):
    """Texts that share half their words fill the buckets, so that pairs meet
    after several splits only; links are counted against all pairs."""
    r = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(260):
        own = [f"w{g}x{i}" for i in range(60)]
        rows.append((len(rows), " ".join(passage + own)))
        near = list(own)
        for k in r.sample(range(60), 2):
            near[k] = f"n{g}{k}"
        rows.append((len(rows), " ".join(passage + near)))
    want = brute_groups(rows)
    true = {i: n for i, n, _ in want}
    assert sum(true.values()) >= 400
    got = {x.doc_id: x for x in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), bucket=24, block=64).collect()}
    assert all(got[i].n_links <= n for i, n in true.items()) and sum(x.n_links for x in got.values()) >= 0.99 * sum(true.values())


def test_mixing_of_very_long_and_of_many_equal_rows(spark):
    df = docs(spark, [(1, "word " * 300_000, "en", "a")] + [(2, "same text here", "de", "b")] * 50 + [(None, "x", None, None)])
    assert spark_rows(mix_to_targets(df, details=True)) == duck(df, mixing_sql())


def test_chunks_and_requests_of_the_suffix_tree_are_packed(spark):
    from lumenlit.llm import suffix_tree as st

    rng = np.random.default_rng(4)
    items = np.minimum(rng.zipf(1.3, 50_000) - 1, 2999).astype(np.int32)
    items = rng.permutation(3000).astype(np.int32)[items]
    counts = np.bincount(items, minlength=3000)
    assert (st._from_planes(st._planes(items, counts), counts) == items).all()
    zipped = lambda x: len(st._packed(x=x))
    assert zipped(st._planes(items, counts)) < 0.85 * zipped(items)
    for code in (np.array([5, 1, 5, 0, 1]), np.array([1 << 62, 3, 1 << 62]), np.zeros(0, np.int64)):
        assert st._sorted_places(code).tolist() == np.argsort(code, kind="stable").tolist()
    for keys in (rng.integers(0, 1 << 63, 500).astype(np.uint64)[rng.integers(0, 500, 2000)], np.array([9, 8, 9, 8, 10], np.uint64)):  # the last differ in their last bits only
        first, place = st._distinct(keys)
        assert (keys[first][place] == keys).all() and len(first) == len(set(keys.tolist())) and (first == [keys.tolist().index(k) for k in keys[first].tolist()]).all()
    n, runs = 4000, np.array([1500, 2500])
    given = rng.integers(1, 1 << 60, 2).astype(np.uint64), np.array([70_000, 32]), runs, rng.integers(0, 1 << 32, n).astype(np.uint32), rng.zipf(2, n), (-256 * rng.integers(1, 20, n)).astype(np.int16)
    made = st._request(*given)
    assert all((x == y).all() for x, y in zip(st._parsed(made), (given[0], given[1], given[2], given[3], given[4], given[5])))
    assert len(made) < 7 * n  # 4 bytes of what follows, 2 of its parent's probability, and the count
    folder = st.shared_dir(spark, "lm-test")
    chunk = st._Chunk()
    chunk.add([1, 2], np.array([True, True]), pa.array(["a b c a b d a b", "b a c d a a b"]))
    rows = chunk.close(0, folder, 4).to_pylist()
    total = {w: c for r in rows if r["bucket"] >= 0 for w, c in zip(r["words"].split(b"\n"), st._wide(r["counts"], r["words"].count(b"\n") + 1, 0)[0].tolist())}
    assert total == {b"a": 6, b"b": 5, b"c": 2, b"d": 2}
    with st.AtomicFile(f"{folder}/0.words") as f:
        data = [len(r["words"].split(b"\n")).to_bytes(4, "little") + r["counts"] for r in rows if r["bucket"] >= 0]
        f.write(st._packed(sizes=np.array([len(x) for x in data], "<i8"), data=b"".join(data)))
    own = st.State(folder, 0, st.Model(17, 5, 2, 4, {}, (0, 0), 1, 1, 20.0, 100, 4))
    own.ask()
    whole = dict(own.requests())
    parts = []
    for turn in range(st._TURNS):  # each context in one turn, with all that follows it
        own.ask(turn)
        parts.append(dict(own.requests()))
    assert not set(parts[0]) & set(parts[1]) and parts[0] | parts[1] == whole and all(parts)
