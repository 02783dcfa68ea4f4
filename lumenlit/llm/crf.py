"""Language of texts by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes of up to three characters, its
character bigrams and trigrams, and whether it stands in the lexicon of each
language (its most frequent words); the field adds learned start weights and
transitions. It is fitted by gradient descent on sequences in which segments of
one or several languages follow one another, so that the transitions cover
code-switched text. Words are labelled by exact forward-backward over the whole
text. With few languages, blocks of words are reduced to transfer matrices,
these are chained from block to block, and the words of all blocks get their
marginals at once; with many, states go from word to word for all texts at
once. A long text is read in pieces, forwards for the states between them, then
backwards for the marginals. The language of a text is the one with the largest
sum of marginals, its score their mean.

Words are runs of letters (Unicode's category L).

The fit uses a bounded sample: about ``per_lang`` labelled rows of each
language, of each a window of at most ``window`` characters. Everything else
reads whole texts.

Cases: null texts and texts without a letter are ``und`` with score 0, as all
texts are if no row has a label; ties go to the label that sorts first;
repeated rows get equal results; an empty table gives no row; very long texts
take the memory of a piece and of their longest word; languages may be many;
other columns are not read, but for those to be kept, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.llm.caches import claim, tidy
from lumenlit.llm.pieces import batches

#: What Python takes for a word character though it is neither letter nor digit.
_SIGNS = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_{re.escape(_SIGNS)}]+")
#: The same without these, which few texts hold.
_NEARLY = re.compile(r"[^\W\d_]+")
_HASH = 1 << 16
_BLOCK = 32
_FEW = 12  # languages, for matrices of blocks
_CELLS = 4_000_000  # numbers that the marginals of one group of words may take, about


def split_words(text: str | None) -> list[str]:
    low = text.lower() if text else ""
    words = _NEARLY.findall(low)
    return words if not words or "".join(words).isalpha() else LETTERS.findall(low)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, and the place where each word's begin."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join(["\x02" + w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(words)), lens)
    mult = np.uint64(0x9E3779B97F4A7C15)
    ids, of = [], []

    def put(key: np.ndarray, who: np.ndarray, kind: int) -> None:
        mixed = (key + np.uint64(kind)) * mult
        ids.append(((mixed ^ mixed >> np.uint64(29)) * mult >> np.uint64(48)).astype(np.int64) % _HASH)
        of.append(who)

    rolled = code.copy()
    for n in (2, 3, 4):  # with the marks at both ends, these hold the affixes of 1 to 3 characters
        rolled = rolled[:-1] * mult + code[n - 1 :] if len(rolled) > 1 else rolled[:0]
        first = np.arange(len(rolled))
        inside = owner[first] == owner[first + n - 1] if len(rolled) else first.astype(bool)
        if n == 4:
            inside &= (code[: len(rolled)] == 2) | (code[3 : 3 + len(rolled)] == 3)
        put(rolled[inside], owner[first][inside], n)
    of_all, ids_all = np.concatenate(of), np.concatenate(ids)
    order = np.argsort(of_all, kind="stable")
    starts = np.searchsorted(of_all[order], np.arange(len(words)))
    del ends
    return ids_all[order], starts


class _Memo:
    """Scores of the words met so far."""

    def __init__(self, width: int):
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, width))

    def add(self, words: list[str], rows: np.ndarray) -> None:
        n = len(self.place)
        while n + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[n : n + len(words)] = rows
        self.place.update(zip(words, range(n, n + len(words))))


@dataclass
class Crf:
    labels: list[str]
    lexicon: dict[str, tuple[int, ...]]  # word -> the languages that list it
    grams: np.ndarray
    lex: np.ndarray
    start: np.ndarray
    trans: np.ndarray

    @property
    def most_words(self) -> int:
        """Words whose marginals are made at once."""
        L = len(self.labels)
        return max(64, _CELLS // (L * L if L <= _FEW else L))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each label; distinct words once."""
        L = len(self.labels)
        if not words:
            return np.zeros((0, L))
        held = claim("crf")
        if held.get("model") is not self or len(held["memo"].place) * (200 + 8 * L) > 30_000_000:
            held["model"], held["memo"] = self, _Memo(L)
        memo = held["memo"]
        new = [w for w in set(words) if w not in memo.place]
        for i in range(0, len(new), 20_000):
            memo.add(new[i : i + 20_000], self._score(new[i : i + 20_000]))
        return memo.rows[np.fromiter(map(memo.place.__getitem__, words), np.int64, len(words))]

    def _score(self, words: list[str]) -> np.ndarray:
        ids, starts = _grams(words)
        if len(ids) * len(self.labels) > 4 * _CELLS and len(words) > 1:
            half = len(words) // 2
            return np.concatenate([self._score(words[:half]), self._score(words[half:])])
        out = np.add.reduceat(self.grams[ids], starts, axis=0)
        word, label = _listed(self.lexicon, words)
        np.add.at(out, word, self.lex[label])
        return out

    def marginals(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Marginals of each word; ``sizes`` are the words of each text, 1 or
        more. Exact over each text, however long."""
        return self.chained(emissions, sizes)[0]

    def chained(self, emissions: np.ndarray, sizes: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None):
        """Marginals of each word, what leads out of each text's last word and
        what leads back from its first. ``before`` leads into the first words
        (the start if None), ``after`` back into the last ones."""
        L = len(self.labels)
        before = np.tile(np.exp(self.start - self.start.max()), (len(sizes), 1)) if before is None else before
        after = np.ones((len(sizes), L)) if after is None else after
        e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        A = np.exp(self.trans - self.trans.max())
        return (_by_blocks if L <= _FEW else _by_words)(e, A, sizes, before, after)

    def long_text(self, text: str, spans: bool):
        """Sum of marginals, number of words, and the best label of each word if
        ``spans``; a piece at a time."""
        A = np.exp(self.trans - self.trans.max())
        states, words, total = [None], 0, np.zeros(len(self.labels))
        parts = list(self._offsets(text))
        for a, b in parts:
            own = split_words(text[a:b])
            _, out, _ = self.chained(self.emissions(own), np.array([len(own)]), states[-1])
            states.append(out @ A)
            words += len(own)
        top, after = [], None
        for (a, b), state in zip(reversed(parts), reversed(states[:-1])):
            own = split_words(text[a:b])
            p, _, back = self.chained(self.emissions(own), np.array([len(own)]), state, after)
            after = back @ A.T
            total += p.sum(axis=0)
            if spans:
                top.append(p.argmax(axis=1))
        return total, words, np.concatenate(top[::-1]) if top else None

    def _offsets(self, text: str):
        """Where to cut a long text so that no word is cut and each piece has
        one."""
        at, most = 0, max(64, min(100_000, self.most_words))
        while at < len(text):
            end = min(len(text), at + most)
            if end < len(text):
                stop = LETTERS.match(text, end)
                end = stop.end() if stop else end
            if LETTERS.search(text, at, end):
                yield at, end
            at = end


def _listed(lexicon: dict[str, tuple[int, ...]], words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a place in ``words`` and a language that lists the word."""
    pairs = [(i, x) for i, w in enumerate(words) for x in lexicon.get(w, ())]
    return tuple(np.array(pairs, np.int64).reshape(-1, 2).T)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _by_words(e: np.ndarray, A: np.ndarray, sizes: np.ndarray, before: np.ndarray, after: np.ndarray):
    """Forward-backward, a word of every text in each step."""
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    longest = -np.sort(-sizes)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    out, back = np.empty_like(before), np.empty_like(before)
    live = [order[: np.searchsorted(-longest, -t, side="left")] for t in range(int(sizes.max()))]  # texts with more than t words
    state = before.copy()
    for t, own in enumerate(live):
        at = first[own] + t
        alpha[at] = _scaled((state[own] if t == 0 else state[own] @ A) * e[at])
        state[own] = alpha[at]
    out[:] = state
    state = after.copy()
    for t in range(len(live) - 1, -1, -1):
        own = live[t]
        at = first[own] + t
        beta[at] = state[own]
        message = _scaled(e[at] * beta[at])
        back[own] = message
        state[own] = message @ A.T
    return _scaled(alpha * beta), out, back


def _by_blocks(e_words: np.ndarray, A: np.ndarray, sizes: np.ndarray, before: np.ndarray, after: np.ndarray):
    """Forward-backward by the transfer matrices of blocks of words."""
    n, L = e_words.shape
    blocks = -(-sizes // _BLOCK)
    first_block = np.cumsum(blocks) - blocks
    text = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    b, k = first_block[text] + within // _BLOCK, within % _BLOCK
    nb = int(blocks.sum())
    e = np.ones((nb, _BLOCK, L))
    e[b, k] = e_words
    steps = np.zeros((nb, _BLOCK), bool)  # where a transition leads in
    steps[b, k] = within > 0
    eye = np.eye(L)
    ahead = np.empty((nb, _BLOCK, L, L))
    m = np.broadcast_to(eye, (nb, L, L))
    for j in range(_BLOCK):
        m = np.where(steps[:, j, None, None], m @ A, m) * e[:, j, None, :]
        m = m / m.max(axis=(1, 2), keepdims=True)
        ahead[:, j] = m
    behind = np.empty((nb, _BLOCK, L, L))
    m = np.broadcast_to(eye, (nb, L, L))
    for j in range(_BLOCK - 1, -1, -1):
        behind[:, j] = m
        m = np.where(steps[:, j, None, None], A @ (e[:, j, :, None] * m), e[:, j, :, None] * m)
        m = m / m.max(axis=(1, 2), keepdims=True)
    whole = ahead[:, -1]
    alpha, beta = np.empty((nb, L)), np.empty((nb, L))
    order = np.argsort(-blocks, kind="stable")
    sorted_blocks = -np.sort(-blocks)
    most = int(blocks.max())
    state = before.copy()
    for j in range(most):
        live = order[: np.searchsorted(-sorted_blocks, -j, side="left")]  # texts with more than j blocks
        at = first_block[live] + j
        alpha[at] = state[live]
        state[live] = _scaled(np.einsum("xi,xij->xj", state[live], whole[at]))
    out, state = state, after.copy()
    for j in range(most - 1, -1, -1):
        live = order[: np.searchsorted(-sorted_blocks, -j, side="left")]
        at = first_block[live] + j
        beta[at] = state[live]
        state[live] = _scaled(np.einsum("xij,xj->xi", whole[at], state[live]))
    p = np.einsum("bi,bkij->bkj", alpha, ahead) * np.einsum("bkij,bj->bki", behind, beta)
    return _scaled(p[b, k]), out, state


def fit(texts: list[tuple[str, str]], lexicon_size: int = 1500, sequences: int = 6000, length: int = 24, steps: int = 40, l2: float = 1e-4, seed: int = 7) -> Crf | None:
    """Fit to (text, label) pairs; None if no text has words."""
    rng = np.random.default_rng(seed)
    split = [(w, label) for w, label in ((split_words(t), label) for t, label in texts) if w]
    if not split:
        return None
    labels = sorted({label for _, label in split})
    L = len(labels)
    counts = {label: Counter() for label in labels}
    for w, label in split:
        counts[label].update(w)
    lexicon: dict[str, tuple[int, ...]] = {}
    for i, label in enumerate(labels):
        for w, _ in sorted(counts[label].items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]:
            lexicon[w] = (*lexicon.get(w, ()), i)
    by_label = [[w for w, x in split if x == label] for label in labels]
    words: list[str] = []
    gold = np.empty((sequences, length), np.int64)
    for s in range(sequences):
        cuts = [0, length] if rng.random() < 0.5 else sorted({0, length, *rng.integers(1, length, rng.integers(1, 3)).tolist()})
        for a, b in zip(cuts[:-1], cuts[1:]):
            label = int(rng.integers(L))
            own = by_label[label][rng.integers(len(by_label[label]))]
            at = int(rng.integers(max(1, len(own) - (b - a) + 1)))
            part = own[at : at + b - a]
            words += [part[i % len(part)] for i in range(b - a)]
            gold[s, a:b] = label
    distinct, place = np.unique(np.array(words, dtype=object), return_inverse=True)
    distinct = distinct.tolist()
    ids, starts = _grams(distinct)
    owner = np.repeat(np.arange(len(distinct)), np.diff(np.append(starts, len(ids))))
    listed, by = _listed(lexicon, distinct)
    place = place.reshape(sequences, length)
    model = Crf(labels, lexicon, np.zeros((_HASH, L)), np.zeros((L, L)), np.zeros(L), np.zeros((L, L)))
    params = [model.grams, model.lex, model.start, model.trans]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    part = max(16, min(sequences, _CELLS // (L * max(L, length))))
    for step in range(1, steps + 1):
        table = np.add.reduceat(model.grams[ids], starts, axis=0)
        np.add.at(table, listed, model.lex[by])
        A = np.exp(model.trans)
        per_word, pairs, begin = np.zeros((len(distinct), L)), np.zeros((L, L)), np.zeros(L)
        for lo in range(0, sequences, part):
            own, right = place[lo : lo + part], gold[lo : lo + part]
            E = table[own]
            e = np.exp(E - E.max(axis=2, keepdims=True))
            alpha, beta = np.empty_like(e), np.ones_like(e)
            alpha[:, 0] = np.exp(model.start) * e[:, 0]
            alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, length):
                alpha[:, t] = (alpha[:, t - 1] @ A) * e[:, t]
                alpha[:, t] /= alpha[:, t].sum(axis=1, keepdims=True)
            for t in range(length - 2, -1, -1):
                beta[:, t] = (beta[:, t + 1] * e[:, t + 1]) @ A.T
                beta[:, t] /= beta[:, t].sum(axis=1, keepdims=True)
            wrong = alpha * beta
            wrong /= wrong.sum(axis=2, keepdims=True)
            np.put_along_axis(wrong, right[:, :, None], np.take_along_axis(wrong, right[:, :, None], 2) - 1.0, 2)
            np.add.at(per_word, own.reshape(-1), wrong.reshape(-1, L))
            begin += wrong[:, 0].sum(axis=0)
            for t in range(1, length):
                x = alpha[:, t - 1, :, None] * A * (e[:, t] * beta[:, t])[:, None, :]
                pairs += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                np.add.at(pairs, (right[:, t - 1], right[:, t]), -1.0)
        grams = np.stack([np.bincount(ids, weights=per_word[owner, j], minlength=_HASH) for j in range(L)], axis=1)
        by_list = np.zeros((L, L))
        np.add.at(by_list, by, per_word[listed])
        scale = 1.0 / sequences
        grads = [grams * scale, by_list * scale, begin * scale, pairs * scale]
        for i, (w, g) in enumerate(zip(params, grads)):
            g = g + l2 * w
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            w -= 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return model


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, learn: Column, per_lang: int, window: int) -> list[tuple[str, str]]:
    """About ``per_lang`` rows of each language, drawn by a hash over all rows
    that may be learned from; of each text a window at a drawn place."""
    rows = docs.filter(learn).select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"), F.xxhash64(F.lit("crf"), F.col(id_col)).alias("h")).filter("l is not null and t is not null")
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return []
    drawn = F.pmod("h", F.lit(1_000_003)) / 1_000_003.0
    limit = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, 1.2 * per_lang / n)]), F.col("l"))
    spare = F.greatest(F.length("t") - window, F.lit(0))
    part = F.substring("t", (F.pmod(F.xxhash64("h"), spare + 1) + 1).cast("int"), F.lit(window))
    found = rows.filter(drawn < limit).select("l", "h", part.alias("t")).orderBy("l", "h", "t").collect()
    kept: dict[str, list[str]] = {}
    for r in found:
        kept.setdefault(r.l, []).append(r.t)
    return [(t, label) for label, own in kept.items() for t in own[:per_lang]]


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, per_lang: int = 250, window: int = 3000, spans: bool = False, model: Crf | None = None, keep: list[str] | None = None, long_text: int = 400_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score; with ``spans``
    also the runs of words of one language (first word, number, language).
    Columns of ``docs`` named in ``keep`` come along unchanged. Texts of more
    than ``long_text`` characters are read in pieces."""
    if model is None:
        model = fit(labelled_sample(docs, id_col, text_col, lang_col, F.lit(True) if learn is None else F.coalesce(learn, F.lit(False)), per_lang, window))
    packed = docs.sparkSession.sparkContext.broadcast(model)  # 65536 rows and the lexicon, whatever the input
    kind = "doc_id long, lang_pred string, score double" + ", spans array<struct<first:long,n:long,lang:string>>" * spans
    schema = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())] + [("spans", pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64()), ("lang", pa.string())])))] * spans

    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_type

    more = [docs.schema[c] for c in keep or []]
    schema += [(f.name, to_arrow_type(f.dataType)) for f in more]

    def runs_of(own: Crf, top: np.ndarray) -> list[dict]:
        cuts = [0, *(np.flatnonzero(np.diff(top)) + 1).tolist(), len(top)]
        return [{"first": a, "n": b - a, "lang": own.labels[top[a]]} for a, b in zip(cuts[:-1], cuts[1:])]

    def some(own: Crf | None, keys: list, texts: list[str | None], rest: list):
        """Rows of texts of which the last may be long, the others not."""
        pred, score, runs = ["und"] * len(keys), [0.0] * len(keys), [[] for _ in keys]

        def put(i: int, total: np.ndarray, n: int, top) -> None:
            best = int(total.argmax())
            pred[i], score[i] = own.labels[best], min(1.0, float(total[best] / n))
            if spans:
                runs[i] = runs_of(own, top)

        def finish(full: list[int], split: list[list[str]]) -> None:
            if not full:
                return
            sizes = np.array([len(w) for w in split])
            p = own.marginals(own.emissions([w for ws in split for w in ws]), sizes)
            starts = np.cumsum(sizes) - sizes
            sums = np.add.reduceat(p, starts, axis=0)
            for row, i in enumerate(full):
                put(i, sums[row], sizes[row], p[starts[row] : starts[row] + sizes[row]].argmax(axis=1) if spans else None)

        full, split, held = [], [], 0
        for i, t in enumerate(texts):
            if own is None or not t:
                continue
            if len(t) > long_text:
                total, n, top = own.long_text(t, spans)
                if n:
                    put(i, total, n, top)
                continue
            words = split_words(t)
            if len(words) > own.most_words:
                put(i, *own.long_text(t, spans))
            elif words:
                if held + len(words) > own.most_words:
                    finish(full, split)
                    full, split, held = [], [], 0
                full.append(i)
                split.append(words)
                held += len(words)
        finish(full, split)
        columns = [pa.array(keys, pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
        if spans:
            columns.append(pa.array(runs, schema[3][1]))
        return pa.RecordBatch.from_arrays(columns + rest, schema=pa.schema(schema))

    def run(stream):
        own = packed.value
        for batch in stream:
            for a, b in batches(batch.column(1).cast(pa.string()), 400_000):
                part = batch.slice(a, b - a)
                yield some(own, part.column(0).to_pylist(), part.column(1).to_pylist(), [part.column(2 + k).cast(schema[k - len(more)][1]) for k in range(len(more))])

    result = T.StructType(T._parse_datatype_string(kind).fields + [T.StructField(f.name, f.dataType) for f in more])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(f"`{f.name}`").alias(f"__keep_{i}") for i, f in enumerate(more)]).mapInArrow(tidy(run), result)
