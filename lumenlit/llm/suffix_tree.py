"""Scoring texts with a probabilistic suffix tree.

Texts are read as words (A-Z lower-cased, cut at ASCII white space) and one end.
The tree's symbols are the words that occur ``min_symbol`` times or more, a
class for each two-byte ending of the other words (for endings that make up
``min_symbol`` tokens), one class for the rest, and the end. The tree grows from
its root: a context of 1 to ``max_depth`` symbols is tested if it occurs
``min_context`` times or more and the context one symbol shorter is kept (or is
the root); it is kept if its next-symbol distribution diverges from that of the
shorter one by more than the description length of its own. Distributions are
smoothed towards the parent's. A word is scored from the state of the longest
kept suffix before it, times the word's smoothed share of its class. Both least
counts are absolute: the tree grows with the corpus.

No part of the model travels whole. Documents are dealt into chunks, each a file
of its words and of their places. For every depth the distinct continuations of
a chunk's contexts go to buckets, with their counts and their parents'
probabilities; there they are summed and the contexts tested, and what a chunk
asked for comes back to it in the order in which it asked. Contexts that occur
more than ``hot`` times are dealt by continuation too: their sums are added up
afterwards, and of these contexts, at most a ``hot``-th part of all tokens, the
kept ones are broadcast. Symbols are told apart by 64 bits of a hash, those that
follow one context by 32. The continuations of single symbols, the most that are
on disk at a time, are counted in turns: each context with all its continuations
in one.

Cases: a null text counts as empty (one token, the end); null ids count as the
empty string when the parts are drawn; repeated rows are learned and scored as
often as they occur; with no training text all counts are 0; very long texts are
scored whole, a chunk of their own; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.llm.caches import claim, tidy
from lumenlit.llm.components import grouped
from lumenlit.llm.pieces import batches
from lumenlit.llm.store import AtomicFile, discard, materialise, read_file, shared_dir

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_START, _END, _REST = (np.uint64(x) for x in (1, 2, 3))  # hashes of these symbols
_STEP = 1024.0  # parents' probabilities travel as rounded logarithms
_TURNS = 2  # in which contexts of one symbol are counted


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _M1
    x = (x ^ x >> np.uint64(29)) * _M2
    return x ^ x >> np.uint64(32)


# --- files ----------------------------------------------------------------------------------------------------------


def _packed(**arrays) -> bytes:
    head, body = {}, []
    for name, x in arrays.items():
        data = x if isinstance(x, bytes) else x.tobytes()
        head[name] = [None if isinstance(x, bytes) else x.dtype.str, len(data)]
        body.append(data)
    raw, top = b"".join(body), json.dumps(head).encode()
    small = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
    return b"".join((len(top).to_bytes(4, "little"), len(raw).to_bytes(8, "little"), top, small))


def _unpacked(data: bytes) -> dict:
    n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little")
    head = json.loads(data[12 : 12 + n])
    raw = pa.decompress(data[12 + n :], size, codec="zstd", asbytes=True) if size else b""
    out, at = {}, 0
    for name, (kind, length) in head.items():
        out[name] = raw[at : at + length] if kind is None else np.frombuffer(raw, kind, length // np.dtype(kind).itemsize, at)
        at += length
    return out


def _narrow(values: np.ndarray, wide: int = 1) -> bytes:
    """Numbers from 0 on in ``wide`` bytes each; those that don't fit follow."""
    top = (1 << 8 * wide) - 1
    big = values[values >= top].astype("<i8")
    return len(big).to_bytes(4, "little") + np.minimum(values, top).astype(f"<u{wide}").tobytes() + big.tobytes()


def _wide(data: bytes, n: int, at: int, wide: int = 1) -> tuple[np.ndarray, int]:
    """The ``n`` numbers that begin here, and where they end."""
    many, at = int.from_bytes(data[at : at + 4], "little"), at + 4
    out = np.frombuffer(data, f"<u{wide}", n, at).astype(np.int64)
    at += n * wide
    if many:
        out[out == (1 << 8 * wide) - 1] = np.frombuffer(data, "<i8", many, at)
    return out, at + 8 * many


def _planes(items: np.ndarray, counts: np.ndarray) -> bytes:
    """Places in a list of words with these counts: the most frequent words get
    the smallest numbers, and the bytes of one weight stand together, which makes
    them easy to pack."""
    rank = np.empty(len(counts), "<u4")
    rank[_by_count(counts)] = np.arange(len(counts), dtype="<u4")
    return rank[items].view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes, counts: np.ndarray) -> np.ndarray:
    ranks = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
    return _by_count(counts).astype(np.int32)[ranks]


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Places, the largest counts first, those from 65,535 on as they come: two
    bytes are sorted faster."""
    return np.argsort((0xFFFF - np.minimum(counts, 0xFFFF)).astype(np.uint16), kind="stable")


def _sorted_places(code: np.ndarray) -> np.ndarray:
    """The places of numbers from 0 on, in the order of these numbers and, where
    they are equal, of places: sorted with the place in the last bits, where it fits."""
    bits = max(1, (len(code) - 1).bit_length()) if len(code) else 1
    if len(code) and int(code.max()).bit_length() + bits > 63:
        return np.argsort(code, kind="stable")
    held = np.left_shift(code, bits)
    held |= np.arange(len(code))
    held.sort()
    held &= (1 << bits) - 1
    return held


def _load(uri: str) -> dict:
    with read_file(uri) as f:
        return _unpacked(f.read())


# --- words ----------------------------------------------------------------------------------------------------------

_WORDS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("docs", pa.int64()), ("ends", pa.int64())])


class _Chunk:
    """Documents that are gathered into a file."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.ids, self.learn, self.lens, self.items, self.size = [], [], [], [], 0

    def add(self, ids: list, learn: np.ndarray, texts: pa.Array) -> None:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        count = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, place = coded.dictionary.to_pylist(), self.place
        to = np.fromiter((place.setdefault(w, len(place)) if w else -1 for w in words), np.int64, len(words))  # white space at an end makes an empty word
        items = to[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(count)), count)[items >= 0]
        self.items.append(items[items >= 0].astype(np.int32))
        self.lens.append(np.bincount(owner, minlength=len(count)))
        self.ids += ids
        self.learn.append(learn)
        self.size += pc.sum(pc.binary_length(texts)).as_py() or 0

    def close(self, chunk: int, folder: str, n_buckets: int) -> pa.RecordBatch:
        """Write the file, with the words in the order of their buckets; a row
        for each bucket."""
        words = [w.encode("utf-8", "surrogatepass") for w in self.place]
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % n_buckets
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        items = rank[np.concatenate(self.items)] if self.items else np.zeros(0, np.int32)
        lens, learn = np.concatenate(self.lens), np.concatenate(self.learn)
        counts = np.bincount(items, weights=np.repeat(learn, lens), minlength=len(words)).astype(np.int64)
        each = np.bincount(items, minlength=len(words))
        words = [words[i] for i in order.tolist()]
        with AtomicFile(f"{folder}/{chunk}.tok") as f:
            f.write(_packed(ids=np.array([0 if i is None else i for i in self.ids], "<i8"), has=np.array([i is not None for i in self.ids], np.uint8), learn=learn.astype(np.uint8), lens=lens.astype("<i8"), items=_planes(items, each), each=_narrow(each), words=b"\n".join(words)))
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        rows = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(words)]):
            if b > a:
                rows.append({"bucket": int(bucket[order[a]]), "chunk": chunk, "words": b"\n".join(words[a:b]), "counts": _narrow(counts[a:b]), "tokens": int(counts[a:b].sum()), "docs": 0, "ends": 0})
        rows.append({"bucket": -1, "chunk": chunk, "words": b"", "counts": b"", "tokens": 0, "docs": len(lens), "ends": int(learn.sum())})
        return pa.RecordBatch.from_pylist(rows, schema=_WORDS)


def _chunks(docs: DataFrame, id_col: str, text_col: str, learn: Column, folder: str, chunk_docs: int, chunk_bytes: int, n_buckets: int) -> DataFrame:
    """Write the chunks. A row for each chunk and bucket of words (joined by
    line feeds, with their counts in training texts), and one for the chunk."""

    def run(stream):
        from pyspark import TaskContext

        claim("suffix_tree")
        seq, own = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in stream:
            texts = pc.fill_null(batch.column(2).cast(pa.string()), "")
            for a, b in batches(texts, chunk_bytes // 4):
                for x in range(a, b, max(1, chunk_docs // 4)):
                    y = min(b, x + max(1, chunk_docs // 4))
                    own.add(batch.column(0).slice(x, y - x).to_pylist(), batch.column(1).slice(x, y - x).to_numpy(zero_copy_only=False).astype(bool), texts.slice(x, y - x))
                    if len(own.ids) >= chunk_docs or own.size >= chunk_bytes:
                        yield own.close(seq, folder, n_buckets)
                        seq, own = seq + 1, _Chunk()
        if own.ids:
            yield own.close(seq, folder, n_buckets)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "bucket long, chunk long, words binary, counts binary, tokens long, docs long, ends long")


def _total_words(partial: DataFrame, least: int) -> DataFrame:
    """Kind 0: the total counts of a chunk's words of a bucket. Kind 1: how many
    words reach ``least``, and how many there are. Kind 2: a two-byte ending,
    with the tokens and distinct words of the others."""
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])

    def run(stream):
        claim("suffix_tree")
        for (bucket,), g in grouped(stream, ["bucket"]):
            total: dict[bytes, int] = {}
            own = [x.split(b"\n") for x in g["words"]]
            for words, counts in zip(own, g["counts"]):
                for w, c in zip(words, _wide(counts, len(words), 0)[0].tolist()):
                    total[w] = total.get(w, 0) + c
            rows = [(0, chunk, bucket, len(words).to_bytes(4, "little") + _narrow(np.fromiter(map(total.__getitem__, words), np.int64, len(words))), 0, 0) for chunk, words in zip(g["chunk"], own)]
            ends: dict[bytes, list[int]] = {}
            frequent = known = 0
            for w, c in total.items():
                known += c > 0
                frequent += c >= least
                if 0 < c < least:
                    e = ends.setdefault(w[-2:], [0, 0])
                    e[0] += c
                    e[1] += 1
            rows.append((1, -1, bucket, b"", frequent, known))
            rows += [(2, -1, bucket, e, c, v) for e, (c, v) in ends.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    words = partial.filter("bucket >= 0").select("bucket", "chunk", "words", "counts")
    return words.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(tidy(run), "kind int, chunk long, bucket long, data binary, tokens long, types long")


def _write_back(rows: DataFrame, folder: str, name: str) -> None:
    """A file for each chunk: the answers (data) to it, in the order of buckets."""

    def run(stream):
        for (chunk,), g in grouped(stream, ["chunk"]):
            with AtomicFile(f"{folder}/{chunk}.{name}") as f:
                f.write(_packed(sizes=np.array([len(x) for x in g["data"]], "<i8"), data=b"".join(g["data"])))
            yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    done = rows.select("chunk", "bucket", "data").repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(tidy(run), "done int")
    discard(materialise(done, f"lm-{name}"))


# --- contexts -------------------------------------------------------------------------------------------------------


class Model:
    """What all chunks need to know: sums, the classes of rare words, and which
    hot contexts of each depth are kept."""

    def __init__(self, n: int, n_types: int, ends: int, n_frequent: int, endings: dict[bytes, tuple[int, int]], rest: tuple[int, int], least: int, min_context: int, weight: float, hot: int, n_buckets: int):
        self.n, self.n_types, self.ends, self.endings, self.rest = n, n_types, ends, endings, rest
        self.least, self.min_context, self.weight, self.hot, self.n_buckets = least, min_context, weight, hot, n_buckets
        self.norm = n + 0.5 * (n_frequent + len(endings) + 2)
        # by the number of an ending: the hash of its class, tokens and types
        self.ending_hash = np.full(65536 + 256, _REST)
        self.ending_tokens, self.ending_types = (np.full(65536 + 256, float(x)) for x in rest)
        for e, (tokens, types) in endings.items():
            at = e[0] * 256 + e[1] if len(e) > 1 else 65536 + e[0]
            self.ending_hash[at], self.ending_tokens[at], self.ending_types[at] = xxhash.xxh3_64_intdigest(b"\0" + e), tokens, types
        self.hot_kept: list[np.ndarray] = []

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.n + 0.5 * (self.n_types + 1)))


def _word_counts(uri: str) -> np.ndarray:
    got = _load(uri)
    out, at = [], 0
    for size in got["sizes"].tolist():
        n = int.from_bytes(got["data"][at : at + 4], "little")
        out.append(_wide(got["data"], n, at + 4)[0])
        at += size
    return np.concatenate(out)


def _endings(words: bytes) -> np.ndarray:
    """The two-byte endings of words joined by line feeds, as numbers; from
    65,536 on those of words of one byte."""
    if not words:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(words + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    lens = np.diff(ends, prepend=-1) - 1
    last, before = raw[ends - 1].astype(np.int64), raw[np.maximum(ends - 2, 0)].astype(np.int64)
    return np.where(lens > 1, before * 256 + last, 65536 + last)


class State:
    """A chunk as far as its answers go."""

    def __init__(self, folder: str, chunk: int, model: Model):
        tok = _load(f"{folder}/{chunk}.tok")
        n_words = tok["words"].count(b"\n") + 1 if tok["words"] else 0
        tok["items"] = _from_planes(tok["items"], _wide(tok.pop("each"), n_words, 0)[0])
        counts = _word_counts(f"{folder}/{chunk}.words") if tok["words"] else np.zeros(0, np.int64)
        self.folder, self.chunk, self.model, self.depth = folder, chunk, model, 0
        self.tok, self.counts_of = tok, counts
        self.learn, self.lens = tok["learn"].astype(bool), tok["lens"]
        rare = counts < model.least
        code = _endings(tok["words"])
        hashes = model.ending_hash[code] if len(code) else np.zeros(0, np.uint64)
        often = np.flatnonzero(~rare)
        if len(often):
            words = tok["words"].split(b"\n")
            hashes[often] = np.fromiter((xxhash.xxh3_64_intdigest(words[i]) for i in often.tolist()), np.uint64, len(often))
        mass = np.where(rare, model.ending_tokens[code], counts).astype(float) if len(code) else np.zeros(0)
        self.rare, self.code = rare, code
        # symbols of this chunk: 0 the start, 1 the end
        every = np.concatenate((np.array([_START, _END]), hashes))
        self.hash, first, to = np.unique(every, return_index=True, return_inverse=True)
        self.mass = np.concatenate(([model.ends, model.ends], mass))[first]
        n, starts = len(tok["items"]), np.cumsum(self.lens + 2) - (self.lens + 2)
        seq = np.empty(n + 2 * len(self.lens), np.int32)
        inner = np.ones(len(seq), bool)
        inner[starts] = inner[starts + self.lens + 1] = False
        seq[inner] = to[2 + tok["items"]]
        seq[starts], seq[starts + self.lens + 1] = to[0], to[1]
        self.seq, self.starts = seq, starts
        self.predicted = np.ones(len(seq), bool)
        self.predicted[starts] = False
        self.learned = np.repeat(self.learn, self.lens + 2) & self.predicted
        self.p = ((self.mass + 0.5) / model.norm)[seq]
        # of the next depth: where each place's context stands in these lists
        self.context = np.concatenate(([-1], seq[:-1].astype(np.int64)))
        self.context_hash, self.context_total = _mix(self.hash), self.mass
        self.context[~self.predicted] = -1
        self.alive = self.predicted.copy()  # whose shorter context is kept

    def ask(self, turn: int | None = None) -> None:
        """The distinct continuations of this depth's contexts, by bucket; given
        a ``turn``, of its contexts only."""
        model, size = self.model, np.int64(len(self.hash))
        turns = self.context_hash >> np.uint64(50) & np.uint64(0x3FF)
        turns = (turns % np.uint64(_TURNS)).astype(np.int32) if self.depth == 0 else np.zeros(len(turns), np.int32)
        ok = np.flatnonzero(self.alive & (self.context >= 0) & (self.context_total[np.maximum(self.context, 0)] >= model.min_context)) if len(self.context_total) else np.zeros(0, np.int64)
        if turn is not None:
            ok = ok[turns[self.context[ok]] == turn]
        code = self.context[ok] * size + self.seq[ok]
        by_code = _sorted_places(code)
        ordered = code[by_code]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ok) else np.zeros(0, bool)
        pairs, at = ordered[new], np.cumsum(new) - 1  # sorted by context, then by what follows
        context, following = pairs // size, pairs % size
        hashes, total = self.context_hash[context], self.context_total[context].astype(np.int64)
        following_hash = _mix(self.hash[following])
        bucket = ((hashes >> np.uint64(1)) % np.uint64(model.n_buckets)).astype(np.int32)
        hot = np.flatnonzero(total > model.hot)
        if len(hot):
            salt = (following_hash[hot] >> np.uint64(20)).astype(np.int64) % -(-total[hot] // model.hot)
            bucket[hot] = (bucket[hot] + salt) % model.n_buckets
        bucket += turns[context] * model.n_buckets
        few = bucket.astype(np.uint16) if _TURNS * model.n_buckets < 1 << 16 else bucket
        order = np.argsort(few, kind="stable")  # contexts stay together: a radix sort of numbers of two bytes
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        placed = ok[by_code]
        self.pair = np.full(len(self.seq), -1, np.int32)
        self.pair[placed] = rank[at]
        first = np.empty(len(pairs), np.int64)
        first[at[::-1]] = placed[::-1]  # any of a pair's places: their parents' probability is one
        counts = np.add.reduceat(self.learned[placed].astype(np.int64), np.flatnonzero(new)) if len(ok) else np.zeros(0, np.int64)
        self.counts, first = counts[order], first[order]
        self.parent = np.rint(np.log2(self.p[first]) * _STEP / 4).astype(np.int16)  # to a 256th; from 2^-128 on
        self.bucket, self.pair_total_of = bucket[order], total[order]
        self.hashes, self.following = hashes[order], following_hash[order].astype(np.uint32)
        self.run = np.concatenate(([True], (np.diff(self.bucket) != 0) | (self.hashes[1:] != self.hashes[:-1]))) if len(order) else np.zeros(0, bool)

    def requests(self):
        """(bucket, bytes) of what was asked."""
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(self.bucket)) + 1, [len(self.bucket)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                run = np.flatnonzero(self.run[a:b])
                yield int(self.bucket[a]), _request(self.hashes[a:b][run], self.pair_total_of[a:b][run], np.diff(np.append(run, b - a)), self.following[a:b], self.counts[a:b], self.parent[a:b])

    def answer(self) -> None:
        """Take the answers of this depth: probabilities, and the contexts of
        the next."""
        model, n = self.model, len(self.bucket)
        totals, kept = np.zeros(n, np.int64), np.zeros(n, bool)
        if n:
            got = _load(f"{self.folder}/{self.chunk}.d{self.depth}")
            runs, at, done = np.cumsum(self.run) - 1, 0, 0
            flags = np.zeros(int(self.run.sum()), np.uint8)
            for size in got["sizes"].tolist():
                data = got["data"][at : at + size]
                at += size
                pairs = int.from_bytes(data[:4], "little")
                totals[done : done + pairs], end = _wide(data, pairs, 4)
                lo = runs[done]
                own = np.frombuffer(data, np.uint8, offset=end)
                flags[lo : lo + len(own)] = own
                done += pairs
            hot = flags == 2
            if hot.any():
                flags[hot] = np.isin(self.hashes[self.run][hot], model.hot_kept[self.depth])
            kept = flags[runs] == 1
        at = np.flatnonzero(self.pair >= 0)
        pair = self.pair[at]
        better = kept[pair]
        self.alive = np.zeros(len(self.seq), bool)
        self.alive[at[better]] = True
        self.p[at[better]] = (totals[pair[better]] + model.weight * self.p[at[better]]) / (self.pair_total_of[pair[better]] + model.weight)
        self.context = np.concatenate(([-1], self.pair[:-1]))
        self.context[~self.predicted] = -1
        self.context_hash, self.context_total = _mix(self.hashes * _M1 + self.following.astype(np.uint64) + np.uint64(1)), totals
        self.depth += 1

    @property
    def ids(self) -> list[int | None]:
        return [i if h else None for i, h in zip(self.tok["ids"].tolist(), self.tok["has"].tolist())]

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each text."""
        model, counts, items = self.model, self.counts_of, self.tok["items"]
        text = np.repeat(np.arange(len(self.lens)), self.lens)
        each = lambda x: np.bincount(text, weights=x[items], minlength=len(self.lens))
        share = np.zeros(len(counts))
        own = np.flatnonzero(self.rare)
        tokens, types = model.ending_tokens[self.code[own]], model.ending_types[self.code[own]]
        share[own] = np.log10((counts[own] + 0.5) / (tokens + 0.5 * (types + 1)))
        known = each(counts > 0).astype(np.int64) + int(model.ends > 0)
        base = each(model.base(counts)) + float(model.base(np.array([model.ends]))[0])
        logs = np.where(self.predicted, np.log10(self.p), 0.0)
        return known, base, (np.add.reduceat(logs, self.starts) if len(self.starts) else np.zeros(0)) + each(share)


def _request(hashes, totals, lens, following, counts, parent) -> bytes:
    rest = b"".join((parent.astype("<i2").view(np.uint8).reshape(-1, 2).T.tobytes(), _narrow(totals, 2), _narrow(lens), _narrow(counts)))
    head = np.array([len(hashes), len(following), len(rest)], "<i4").tobytes()
    return b"".join((head, hashes.astype("<u8").tobytes(), following.astype("<u4").tobytes(), pa.compress(rest, codec="zstd", asbytes=True)))


def _parsed(data: bytes):
    c, n, size = np.frombuffer(data, "<i4", 3).tolist()
    hashes, following = np.frombuffer(data, "<u8", c, 12), np.frombuffer(data, "<u4", n, 12 + 8 * c)
    rest = pa.decompress(data[12 + 8 * c + 4 * n :], size, codec="zstd", asbytes=True)
    parent = np.ascontiguousarray(np.frombuffer(rest, np.uint8, 2 * n).reshape(2, -1).T).view("<i2").reshape(-1)
    totals, at = _wide(rest, c, 2 * n, 2)
    lens, at = _wide(rest, c, at)
    return hashes, totals, lens, following, _wide(rest, n, at)[0], parent


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 64-bit keys: the first place of each distinct one, and at each place
    the number of its key in that list. They are sorted with the place in the
    last bits; keys that only differ in these fall back on a slower sort."""
    bits = np.uint64(max(1, (len(keys) - 1).bit_length()))
    last = (np.uint64(1) << bits) - np.uint64(1)
    held = keys & ~last | np.arange(len(keys), dtype=np.uint64)
    held.sort()
    at = (held & last).astype(np.int64)
    change = keys[at[1:]] != keys[at[:-1]]
    if (change & (held[1:] >> bits == held[:-1] >> bits)).any():
        _, first, place = np.unique(keys, return_index=True, return_inverse=True)
        return first, place
    new = np.concatenate(([True], change))
    place = np.empty(len(keys), np.int64)
    place[at] = np.cumsum(new) - 1
    return at[new], place


def diverges(gain, continuations, total):
    """The test: more than the description length of the distribution."""
    return gain > 0.5 * (continuations - 1) * np.log(total) + np.log(total)


def _sums(data: list[bytes], weight: float, hot: int):
    """Of one bucket: the answers to all requests, and (hash, total, gain,
    parents' mass, continuations) of each hot context."""
    parsed = [_parsed(x) for x in data]
    hashes, total, lens, following, counts, parent = (np.concatenate(c) for c in zip(*parsed))
    own = np.repeat(hashes, lens)
    first, place = _distinct(_mix(own * _M1 + following.astype(np.uint64)))
    n = np.bincount(place, weights=counts, minlength=len(first))
    context, where = np.unique(hashes, return_inverse=True)
    of = np.repeat(where, lens)[first]
    size = np.empty(len(context))
    size[where] = total
    p, T = 2.0 ** (parent[first] * 4 / _STEP), size[of]
    q = (n + weight * p) / (T + weight)
    seen = n > 0
    add = lambda x: np.bincount(of[seen], weights=x[seen], minlength=len(context))
    gain, mass, k = add(q * np.log(q / p)), add(p), add(np.ones(len(q)))
    is_hot = size > hot
    flags = np.where(is_hot, 2, diverges(_gain(gain, mass, size, weight), k, size)).astype(np.uint8)
    answers, at, at_pair = [], 0, 0
    for h, _, _, f, _, _ in parsed:
        answers.append(len(f).to_bytes(4, "little") + _narrow(n[place[at_pair : at_pair + len(f)]].astype(np.int64)) + flags[where[at : at + len(h)]].tobytes())
        at, at_pair = at + len(h), at_pair + len(f)
    return answers, [(int(context.astype(np.int64)[i]), float(size[i]), float(gain[i]), float(mass[i]), float(k[i])) for i in np.flatnonzero(is_hot)]


def _gain(gain, mass, total, weight):
    """Divergence from the parent times the total: what was not seen keeps the
    same share of its parent's probability."""
    rest = weight / (total + weight)
    return total * (gain + rest * np.maximum(0.0, 1.0 - mass) * np.log(rest))


def _state(folder: str, chunk: int, model: Model, depth: int) -> State:
    own = State(folder, chunk, model)
    for _ in range(depth):
        own.ask()
        own.answer()
    return own


def _count_contexts(listed: DataFrame, folder: str, shared, depth: int, turn: int) -> DataFrame:
    """Of the contexts of one turn, kind 0: the answer to a chunk from a bucket.
    Kind 1: sums of a hot context, packed."""
    requests = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary()), ("total", pa.float64()), ("gain", pa.float64()), ("mass", pa.float64()), ("k", pa.float64())])

    def ask(stream):
        claim("suffix_tree")
        for batch in stream:
            for chunk in batch.column(0).to_pylist():
                own = _state(folder, chunk, shared.value, depth)
                own.ask(turn)
                rows = list(own.requests())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], schema=requests)

    def run(stream):
        claim("suffix_tree")
        model = shared.value
        for (bucket,), g in grouped(stream, ["bucket"]):
            answers, hot = _sums(g["data"], model.weight, model.hot)
            rows = [(0, chunk, bucket, x, 0.0, 0.0, 0.0, 0.0) for chunk, x in zip(g["chunk"], answers)]
            rows += [(1, context, bucket, b"", *sums) for context, *sums in hot]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    asked = listed.mapInArrow(tidy(ask), "bucket long, chunk long, data binary")
    return asked.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(tidy(run), "kind int, chunk long, bucket long, data binary, total double, gain double, mass double, k double")


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None, min_symbol: int = 8, min_context: int = 32, max_depth: int = 3, weight: float = 20.0, docs_per_chunk: int = 4096, chunk_bytes: int = 12_000_000, hot: int = 1_000_000) -> DataFrame:
    """Learn from the rows where ``learn`` holds (default: all), score all.

    Returns id, learned, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "lm")
    learn = F.lit(True) if learn is None else learn
    size = docs.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    n_buckets = max(64, 2 * max((size[0] or 0) // docs_per_chunk, (size[1] or 0) // chunk_bytes))
    partial = materialise(_chunks(docs, id_col, text_col, learn, folder, docs_per_chunk, chunk_bytes, n_buckets), "lm-words")
    words, ends, n_chunks = partial.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("ends"), F.lit(0)), F.count_if(F.col("bucket") < 0)).first()
    listed = materialise(partial.filter("bucket < 0").select("chunk"), "lm-chunks").repartition(max(1, min(n_chunks, 10_000)), "chunk")
    totals = materialise(_total_words(partial, min_symbol), "lm-totals")
    _write_back(totals.filter("kind = 0"), folder, "words")
    frequent, types = totals.filter("kind = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    endings = totals.filter("kind = 2").groupBy("data").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect()  # 65,536 at most, and of one byte
    discard(partial, totals)
    large = {bytes(r.data): (r.tokens, r.types) for r in endings if r.tokens >= min_symbol}
    small = [r for r in endings if r.tokens < min_symbol]
    n = words + ends
    model = Model(n, types + (ends > 0), ends, frequent, large, (sum(r.tokens for r in small), sum(r.types for r in small)), min_symbol, min_context, weight, hot, n_buckets)

    for depth in range(max_depth if n_chunks else 0):
        shared = spark.sparkContext.broadcast(model)
        parts = [materialise(_count_contexts(listed, folder, shared, depth, turn), f"lm-depth{depth}") for turn in range(1 if depth else _TURNS)]
        counted = functools.reduce(DataFrame.union, parts)
        _write_back(counted.filter("kind = 0"), folder, f"d{depth}")
        hots = counted.filter("kind = 1").groupBy("chunk").agg(F.max("total").alias("total"), F.sum("gain").alias("gain"), F.sum("mass").alias("mass"), F.sum("k").alias("k")).collect()  # at most a hot-th part of all tokens
        kept = [r.chunk for r in hots if diverges(_gain(r.gain, r.mass, r.total, weight), r.k, r.total)]
        model.hot_kept.append(np.array(kept, np.int64).astype(np.uint64))
        discard(*parts)

    packed = spark.sparkContext.broadcast(model)  # 65,536 endings, and the hot contexts
    schema = pa.schema([("id", pa.int64()), ("learned", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(stream):
        claim("suffix_tree")
        for batch in stream:
            for chunk in batch.column(0).to_pylist():
                own = _state(folder, chunk, packed.value, max_depth)
                known, base, score = own.scores()
                yield pa.RecordBatch.from_arrays([pa.array(own.ids, pa.int64()), pa.array(own.learn), pa.array(own.lens + 1), pa.array(known), pa.array(np.full(len(known), n, np.int64)), pa.array(base), pa.array(score)], schema=schema)

    return listed.mapInArrow(tidy(run), "id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
