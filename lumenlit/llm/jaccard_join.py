"""Similarity join of texts by the Jaccard index of their five-word shingles.

1. Every text becomes its set of shingle hashes; equal sets form a class, which
   goes on once. A class has a sketch: the smallest hash of each of ``tokens``
   bins (empty bins borrow from the next full one). A sketch's tokens (bin,
   value) agree between two sets with the probability of their Jaccard index.
   Eight bits of each travel; sets that differ agree in them a little more
   often, never less.
2. Chosen-path recursion: each of ``runs`` runs splits all classes on the whole
   token of one sampled bin. Buckets of at most ``bucket`` classes are compared
   by brute force. In a larger one, classes are first compared with its pivot;
   those whose sketches are all but equal to its own are bound to it and leave.
   The share of differing bins is a metric: only what comes within ``1 - near``
   of the pivot's own margin can be a candidate of one that leaves, and such
   classes that the pivot does not bind are compared with all that leave, so a
   large bucket loses no candidate by it. The others are split again, on two
   bins sampled for this path, or, where a tenth resembles the pivot, compared
   block by block, as what is still too large at ``depth`` is. A pair of
   similarity s stays together with probability s in the first split of a run
   and 1-(1-s)^2 in each of at most ``depth`` more; ``runs`` is taken so that
   all runs together miss it with at most 1 - ``recall`` even at full depth.
3. Candidates, found with a margin of four standard errors where their sizes
   allow a link, only bind classes into families. Families of more than a block
   fall into parts whose sets share no shingle of their prefixes, and so cannot
   link. Inside a part the sets themselves are compared, every pair: links are
   exact and none between members is lost. Parts of more than a block keep their
   blocks as files, which pairs of blocks read.

Words are runs between white space, A-Z lower-cased. Texts of one to four words
have one shingle, all their words; texts without words, null ones too, have
none and link with nothing.

Cases: repeated rows are copies of one class; a null id is a row as any other,
and ids of groups are the smallest that is not null; an empty table gives no
row; very long texts are compared whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenlit.llm.caches import claim, tidy
from lumenlit.llm.components import components, forest, grouped
from lumenlit.llm.pieces import batches
from lumenlit.llm.store import AtomicFile, discard, materialise, read_file, shared_dir

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * _MULT[3]
    x = (x ^ x >> np.uint64(27)) * _MULT[1]
    return x ^ x >> np.uint64(31)


def _rolled(h: np.ndarray, span: int) -> np.ndarray:
    n = len(h) - span + 1
    out = np.full(n, span, np.uint64)
    for k in range(span):
        out = _mix(out * _MULT[k % len(_MULT)] + h[k : k + n])
    return out


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    count = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    index = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(count)), count)
    full = np.array([bool(w) for w in words], bool)[index]  # white space at an end makes an empty word
    h, owner = hashes[index][full], owner[full]
    count = np.bincount(owner, minlength=len(count))
    begin = np.cumsum(count) - count
    out = [np.zeros(0, np.uint64)] * len(count)
    if len(h) >= size:
        rolled = _rolled(h, size)
        for i in np.flatnonzero(count >= size).tolist():
            out[i] = np.unique(rolled[begin[i] : begin[i] + count[i] - size + 1])
    for i in np.flatnonzero((count > 0) & (count < size)).tolist():
        out[i] = _rolled(h[begin[i] : begin[i] + count[i]], int(count[i]))
    return out


def sketch(shingles: np.ndarray, tokens: int) -> np.ndarray:
    """The smallest hash in each bin, 32 bits; empty bins borrow."""
    mixed = _mix(shingles * _MULT[2] + np.uint64(1))
    bins = (mixed >> np.uint64(40)) % np.uint64(tokens)
    out = np.full(tokens, 1 << 32, np.uint64)
    np.minimum.at(out, bins.astype(np.int64), mixed & np.uint64(0xFFFFFFFF))
    full = np.flatnonzero(out < 1 << 32)
    nearest = full[np.searchsorted(full, np.arange(tokens)) % len(full)]
    away = (nearest - np.arange(tokens)) % tokens
    return ((out[nearest] + away.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def _bins(path: int, count: int, tokens: int) -> list[int]:
    """Bins sampled for a path; every class on it gets the same ones."""
    state = np.uint64(path % 2**64) + np.arange(1, count + 1, dtype=np.uint64) * _MULT[1]
    return sorted({int(x) for x in _mix(state) % np.uint64(tokens)})


def _least(n_shingles: np.ndarray, other, threshold: float, tokens: int):
    """What the estimate of a pair at the threshold exceeds almost surely."""
    n = np.maximum(1, np.minimum(np.minimum(n_shingles, other), tokens))
    return threshold - 4 * np.sqrt(threshold * (1 - threshold) / n)


def could_link(n_shingles, other, threshold: float):
    """Whether sets of these sizes that aren't equal can reach the threshold: at
    best one holds the other, or, at equal sizes, all but one of it."""
    least, most = np.minimum(n_shingles, other), np.maximum(n_shingles, other)
    same = least == most
    return least - same >= threshold * (most + same) - 1e-6


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _key(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _describe(docs: DataFrame, size: int, tokens: int, roots: list[int]) -> DataFrame:
    """doc_id, key (16-byte digest of the set; null if empty), n shingles, the
    sketch (a byte for each bin), and the path of each run (8 bytes each)."""

    def run(stream):
        claim("jaccard_join")
        for batch in stream:
            for a, b in batches(batch.column(1), 2_000_000):
                keys, ns, sketches, paths = [], [], [], []
                for s in shingle_sets(batch.column(1).slice(a, b - a), size):
                    ns.append(len(s))
                    keys.append(_key(s))
                    whole = sketch(s, tokens) if len(s) else None
                    sketches.append(None if whole is None else whole.astype(np.uint8).tobytes())
                    paths.append(None if whole is None else root_paths(whole, roots).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.binary()), pa.array(ns, pa.int64()), pa.array(sketches, pa.binary()), pa.array(paths, pa.binary())], names=["doc_id", "key", "n", "sketch", "paths"])

    return docs.mapInArrow(tidy(run), "doc_id long, key binary, n long, sketch binary, paths binary")


def _kind(rows: DataFrame) -> str:
    return f"key {rows.schema['key'].dataType.simpleString()}"


def root_paths(sketches: np.ndarray, roots: list[int]) -> np.ndarray:
    """The path of each run."""
    return _mix(sketches[..., roots].astype(np.uint64) + (np.arange(1, len(roots) + 1, dtype=np.uint64) << np.uint64(40)))


def _roots(classes: DataFrame, runs: int, tokens: int, whole: bool = False) -> DataFrame:
    """A row for each run of a class: path, key, and n and sketch if ``whole``.
    The paths were made with the whole sketches, or are made with what is there."""
    kind, made = _kind(classes), "paths" in classes.columns
    more = ["n", "sketch"] if whole else []

    def run(stream):
        for batch in stream:
            if made:
                paths = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(-1, runs)
            else:
                paths = root_paths(_sketches(batch.column(1).to_pylist(), tokens), spread(runs, tokens)).astype(np.int64)
            for k in range(runs):
                yield pa.RecordBatch.from_arrays([pa.array(paths[:, k].copy()), batch.column(0), *batch.columns[2:]], names=["path", "key", *more])

    return classes.select("key", "paths" if made else "sketch", *more).mapInArrow(tidy(run), f"path long, {kind}" + ", n long, sketch binary" * whole)


def spread(runs: int, tokens: int) -> list[int]:
    """The first bin of each run."""
    return [i * tokens // runs % tokens for i in range(runs)]


def _sketches(many: list[bytes], tokens: int) -> np.ndarray:
    """Tokens of one byte or of four."""
    data = b"".join(many)
    return np.frombuffer(data, np.uint8 if len(data) == len(many) * tokens else "<u4").reshape(-1, tokens)


def _split(rows: DataFrame, tokens: int) -> DataFrame:
    """A row for each token on which a class is split: path, key, n, sketch. The
    two bins are sampled for the row's own path."""
    kind = _kind(rows)

    def run(stream):
        for batch in stream:
            ids, values, paths = batch.column(0), _sketches(batch.column(1).to_pylist(), tokens), batch.column(2).to_numpy()
            own, inverse = np.unique(paths, return_inverse=True)
            chosen = [_bins(int(p), 2, tokens) for p in own]
            for k in (0, 1):
                has = np.array([len(c) > k for c in chosen])[inverse]
                where = np.array([c[min(k, len(c) - 1)] for c in chosen])[inverse]
                at = np.flatnonzero(has)
                value = _mix(values[np.arange(len(values)), where].astype(np.uint64) + (where.astype(np.uint64) << np.uint64(33)))
                new = _mix(paths.astype(np.uint64) * _MULT[0] + value).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(new[at]), *(c.take(pa.array(at)) for c in (ids, batch.column(3), batch.column(1)))], names=["path", "key", "n", "sketch"])

    return rows.select("key", "sketch", "path", "n").mapInArrow(tidy(run), f"path long, {kind}, n long, sketch binary")


def _brute(rows: DataFrame, by: list[str], tokens: int, threshold: float) -> DataFrame:
    """Edges that bind the candidates of every bucket, at most one for each of
    its classes."""
    kind = _kind(rows)
    of = to_arrow_type(rows.schema["key"].dataType)

    def run(stream):
        for _, g in grouped(stream, by):
            m = len(g["key"])
            if m < 2:
                continue
            s = _sketches(g["sketch"], tokens)
            n = np.array(g["n"])
            open_, rows = np.arange(m), []
            while len(open_):  # each class is compared until something reaches it
                root, open_ = open_[0], open_[1:]
                reached = [root]
                while reached and len(open_):
                    i = reached.pop()
                    hit = could_link(n[open_], n[i], threshold)
                    at = np.flatnonzero(hit)
                    hit[at] = (s[open_[at]] == s[i]).mean(axis=1) >= _least(n[open_[at]], n[i], threshold, tokens)
                    new = open_[hit].tolist()
                    rows += [(x, root) for x in new]
                    reached += new
                    open_ = open_[~hit]
            if rows:
                yield pa.RecordBatch.from_pydict({"a": pa.array([g["key"][i] for i, _ in rows], of), "b": pa.array([g["key"][r] for _, r in rows], of)})

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(tidy(run), f"a {kind[4:]}, b {kind[4:]}")


def _pivots(rows: DataFrame, first: DataFrame, tokens: int, threshold: float, near: float) -> DataFrame:
    """Rows of large buckets (path and pivot, ps, pn: the key, sketch and size of
    its pivot, in ``first``) and how they relate to it: same (share of equal
    bins), edge (a candidate), gone (all but equal, or the pivot itself)."""
    kind = _kind(rows)

    def run(stream):
        for batch in stream:
            own = _sketches(batch.column(3).to_pylist(), tokens)
            pivot = _sketches(batch.column(5).to_pylist(), tokens)
            n, m = batch.column(2).to_numpy(), batch.column(6).to_numpy()
            same = (own == pivot).mean(axis=1)
            edge = (same >= _least(n, m, threshold, tokens)) & could_link(n, m, threshold)
            itself = pc.equal(batch.column(1), batch.column(4)).to_numpy(zero_copy_only=False)
            gone = (same >= near) & edge | itself
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(same), pa.array(edge), pa.array(gone)], names=["path", "key", "n", "sketch", "pivot", "same", "edge", "gone"])

    joined = rows.join(F.broadcast(first), "path").select("path", "key", "n", "sketch", "pivot", "ps", "pn")
    return joined.mapInArrow(tidy(run), f"path long, {kind}, n long, sketch binary, pivot {kind[4:]}, same double, edge boolean, gone boolean")


def _blocks(rows: DataFrame, by: str, sizes: DataFrame, block: int) -> DataFrame:
    """Rows of large groups dealt to pairs of blocks: columns lo, hi; every two
    rows of a group meet in at least one pair."""
    cut = rows.join(F.broadcast(sizes.select(by, F.ceil(F.col("size") / block).cast("int").alias("blocks"))), by).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return cut.withColumn("other", other).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def _left_out(seen: DataFrame, tokens: int, threshold: float, near: float, block: int) -> DataFrame:
    """Rows dealt to pairs of blocks (path, lo, hi) so that every class that
    leaves meets every class that it may bind and its pivot does not.

    Of three sketches, d(y, pivot) <= d(y, x) + d(x, pivot) for the share d of
    differing bins, and d(x, pivot) <= 1 - near for each x that leaves."""
    left = seen.filter("gone and key != pivot")
    fewest = left.groupBy("path").agg(F.count("*").alias("left"), F.min("n").alias("fewest"))
    n = F.greatest(F.lit(1), F.least("n", "fewest", F.lit(tokens)))
    least = F.lit(threshold) - 4 * F.sqrt(threshold * (1 - threshold) / n)
    open_ = seen.filter("not edge").join(F.broadcast(fewest), "path").filter(F.col("same") >= least - (1 - near) - 1e-9)
    sizes = open_.groupBy("path", "left").agg(F.count("*").alias("open")).select("path", *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("left", "open")])
    out = []
    for rows, own, other, own_name, other_name in ((left, "left", "open", "lo", "hi"), (open_.drop("left"), "open", "left", "hi", "lo")):
        dealt = rows.join(F.broadcast(sizes), "path").withColumn(own_name, F.pmod(F.xxhash64("key"), F.col(own)).cast("int"))
        out.append(dealt.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("path", "lo", "hi", "key", "n", "sketch"))
    return out[0].union(out[1])


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs that find a pair at the threshold with this probability, were it
    split ``depth`` times in each."""
    stays = threshold * (1 - (1 - threshold) ** 2) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - stays)))


#: Buckets of more than one class that each executor gets, 16 bytes each.
_FEW = 500_000


def candidate_edges(classes: DataFrame, threshold: float, tokens: int, runs: int, bucket: int, depth: int) -> DataFrame:
    """Edges (a, b) between keys that bind every candidate family. ``classes``
    has key, n, sketch, and may have the paths of the runs."""
    rows = materialise(_roots(classes, runs, tokens), "paths")
    described = classes.select("key", "n", "sketch")
    first = _roots(classes, runs, tokens, whole=True)  # made anew where it meets few paths, not kept
    found = []
    near = (1 + threshold) / 2
    for level in range(depth + 1):
        sizes = materialise(rows.groupBy("path").agg(F.count("*").alias("size"), F.min("key").alias("pivot")).filter("size > 1"), "sizes")
        brief = sizes.count() <= _FEW
        if level:
            held = rows.join(F.broadcast(sizes.select("path", "size")) if brief else sizes.select("path", "size"), "path")
        else:
            held = first.join(F.broadcast(sizes.select("path", "size")), "path") if brief else rows.join(sizes.select("path", "size"), "path").join(described, "key")
        some = held.filter(F.col("size") <= bucket).select("path", "key", "n", "sketch")
        found.append(materialise(_brute(some, ["path"], tokens, threshold), "edges"))
        large = sizes.filter(F.col("size") > bucket)  # one for each ``bucket`` rows at most
        if not large.limit(1).count():
            discard(sizes)
            break
        middle = large.select("path", "pivot").join(described.select(F.col("key").alias("pivot"), F.col("sketch").alias("ps"), F.col("n").alias("pn")), "pivot")
        seen = materialise(_pivots(rows if level else first, middle, tokens, threshold, near), "pivots")
        # a bucket of near-copies would not get smaller by any split
        alike = materialise(seen.groupBy("path").agg(F.count_if("edge").alias("hits"), F.count("*").alias("all"), F.count_if(~F.col("gone")).alias("size")), "alike")
        block = F.lit(level == depth) | (F.col("hits") >= 0.1 * F.col("all"))
        rest = seen.filter(~F.col("gone")).select("path", "key", "n", "sketch")
        dealt = _blocks(rest, "path", alike.filter(block), bucket // 2).select("path", "lo", "hi", "key", "n", "sketch")
        met = _left_out(seen, tokens, threshold, near, bucket // 2).withColumn("rest", F.lit(False)).union(dealt.withColumn("rest", F.lit(True)))
        edges = seen.filter("edge and key != pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
        found.append(materialise(edges.union(_brute(met, ["rest", "path", "lo", "hi"], tokens, threshold)), "edges"))
        if level < depth:
            deeper = materialise(_split(rest.join(F.broadcast(alike.filter(~block).select("path")), "path", "left_semi"), tokens), "paths")
        discard(sizes, seen, alike)
        if level < depth:
            discard(rows)
            rows = deeper
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    edges = materialise(out.distinct(), "candidates")
    discard(rows, *found)
    return edges


# --- exact comparison -----------------------------------------------------------------------------------------------


def _common(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many values each two of these sets share: among ``left``, or between
    ``left`` and ``right``."""
    sets = left + (right or [])
    a, m = len(left), len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    column = np.cumsum(common) - 1
    kept = common[inverse]
    col, row = column[inverse[kept]], owner[kept]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    shared = np.zeros((a, m - a if right else m), np.float32)
    width = max(256, (1 << 21) // m)
    for begin in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(col, (begin, begin + width))
        x = np.zeros((m, width), np.float32)
        x[row[lo:hi], col[lo:hi] - begin] = 1
        shared += x[:a] @ (x[a:] if right else x).T
    return shared


def _links(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    p, q = (np.array([len(x) for x in s]) for s in (left, left if right is None else right))
    shared = _common(left, right)
    link = shared >= threshold * (p[:, None] + q[None, :] - shared) - 1e-6
    if right is None:
        np.fill_diagonal(link, False)
    return link


def _pack_block(ids: list[int], copies: list[int], sets: list[np.ndarray]) -> bytes:
    head = np.array([ids, copies, [len(x) for x in sets]], "<i8")
    return struct.pack("<q", len(ids)) + head.tobytes() + b"".join(x.tobytes() for x in sets)


def _read_block(uri: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    with read_file(uri) as f:
        data = f.read()
    m = struct.unpack_from("<q", data)[0]
    ids, copies, sizes = np.frombuffer(data, "<i8", 3 * m, 8).reshape(3, m)
    flat = np.frombuffer(data, "<u8", offset=8 + 24 * m)
    return ids, copies, np.split(flat, np.cumsum(sizes)[:-1])


_LINKS = "id long, links long, root long"


def _rows(ids, links: np.ndarray, root) -> pa.RecordBatch:
    ids = np.asarray(ids, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64)), pa.array(ids[root])], names=["id", "links", "root"])


def _within(members: DataFrame, threshold: float, folder: str) -> DataFrame:
    """Links inside each block of a family (family, own, blocks, id, copies,
    shingles): id, links (copies of linked classes), root (a class it reaches).
    Blocks of larger families are written to ``folder``."""

    def run(stream):
        claim("jaccard_join")
        for (family, own), g in grouped(stream, ["family", "own"]):
            first = list({i: k for k, i in reversed(list(enumerate(g["id"])))}.values())  # rows of one id and text repeat
            ids, copies = ([g[c][k] for k in first] for c in ("id", "copies"))
            sets = [np.frombuffer(g["shingles"][k], "<u8") for k in first]
            if g["blocks"][0] > 1:
                with AtomicFile(f"{folder}/{family}-{own}") as f:
                    f.write(_pack_block(ids, copies, sets))
            link = _links(sets, None, threshold)
            yield _rows(ids, link @ np.array(copies), forest(len(ids), *np.nonzero(np.triu(link))))

    by = ["family", "own"]
    return members.select(*by, "blocks", "id", "copies", "shingles").repartition(*by).sortWithinPartitions(*by).mapInArrow(tidy(run), _LINKS)


def _between(pairs: DataFrame, threshold: float, folder: str) -> DataFrame:
    """The same for links between two blocks (family, lo, hi) of a family. A
    block to which no class was dealt has no file."""

    def run(stream):
        claim("jaccard_join")
        for batch in stream:
            for family, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    (p, p_copies, left), (q, q_copies, right) = _read_block(f"{folder}/{family}-{lo}"), _read_block(f"{folder}/{family}-{hi}")
                except FileNotFoundError:
                    continue
                link = _links(left, right, threshold)
                i, j = np.nonzero(link)
                yield _rows(np.concatenate((p, q)), np.concatenate((link @ q_copies, p_copies @ link)), forest(len(p) + len(q), i, j + len(p)))

    return pairs.select("family", "lo", "hi").repartition(F.xxhash64("family", "lo", "hi")).mapInArrow(tidy(run), _LINKS)


#: Shingles that come last in prefixes as the most frequent ones: at most so many.
_FREQUENT = 50_000


def _parts(sets: DataFrame, threshold: float) -> DataFrame:
    """id, part: members that can link have one part. Of two sets that reach the
    threshold, the larger share of each is in the other, so that in one order of
    all shingles (rare ones first) their prefixes meet: the n - ceil(threshold *
    n) + 1 first ones of n. Parts are the components of ids and the shingles of
    their prefixes (negative nodes)."""

    def flat(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8"))], names=["shingle"])

    shingles = sets.select("shingles").mapInArrow(tidy(flat), "shingle long")
    counted = materialise(shingles.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"), "shingle-counts")
    many = max(2, (counted.agg(F.sum("n")).first()[0] or 0) // _FREQUENT)
    known = counted.filter(F.col("n") > many).orderBy("shingle").toArrow()  # 16 bytes a row
    often, times = (known.column(k).to_numpy() for k in (0, 1))

    def run(stream):
        for batch in stream:
            ids, nodes = [], []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(data, "<i8")
                at = np.minimum(np.searchsorted(often, x), max(0, len(often) - 1))
                rank = np.where(often[at] == x, times[at], 0) if len(often) else np.zeros(len(x), np.int64)
                first = x[np.lexsort((x, rank))[: len(x) - math.ceil(threshold * len(x) - 1e-5) + 1]]
                nodes.append(-1 - (first & 0x7FFFFFFFFFFFFFFF))
                ids.append(np.full(len(first), i))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(nodes))], names=["id", "node"])

    edges = sets.select("id", "shingles").mapInArrow(tidy(run), "id long, node long")
    out = materialise(components(edges, "id", "node").filter("node >= 0").select(F.col("node").alias("id"), F.col("component").alias("part")), "parts")
    discard(counted)
    return out


def _parted(sets: DataFrame, threshold: float, block: int, block_shingles: int) -> DataFrame:
    """The rows of families of more than a block, dealt anew by their parts."""
    rows = sets.join(_parts(sets, threshold), "id")
    sizes = rows.groupBy("part").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.length("shingles") / 8) / block_shingles)).cast("int").alias("n"))
    dealt = rows.join(materialise(sizes, "part-sizes"), "part")
    return dealt.select(F.col("part").alias("family"), F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("own"), F.col("n").alias("blocks"), "id", "copies", "shingles")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, tokens: int = 64, recall: float = 0.9999, bucket: int = 1024, depth: int = 3, block: int = 512, block_shingles: int = 400_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, copies (rows with the
    same set, itself included), n_links (other rows at ``threshold`` or more,
    copies included), class_id (the smallest id of its group by links), kept
    (the first row of its group)."""
    spark = docs.sparkSession
    runs = runs_for(recall, threshold, depth)
    read = _read(docs, id_col, text_col)
    described = materialise(_describe(read, size, tokens, spread(runs, tokens)), "shingles")
    once = described.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    classes = materialise(once.withColumn("id", F.monotonically_increasing_id()), "classes")
    edges = candidate_edges(classes.select(F.col("id").alias("key"), "n", "sketch", "paths"), threshold, tokens, runs, bucket, depth)
    families = components(edges, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("family"))
    joined = materialise(families.join(classes.select("id", "key", "n", "first", "copies"), "id"), "families")
    discard(edges)
    sizes = joined.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    wanted = materialise(joined.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("n"), "members")

    def sets(stream):
        claim("jaccard_join")
        names = ["family", "own", "blocks", "id", "copies"]
        for batch in stream:
            for a, b in batches(batch.column(0), 2_000_000):
                part = batch.slice(a, b - a)
                found, keys = shingle_sets(part.column(0), size), part.column(1).to_pylist()
                at = [i for i, s in enumerate(found) if _key(s) == keys[i]]  # an id may stand on other texts too
                if at:
                    yield pa.RecordBatch.from_arrays([*(part.column(2 + k).take(pa.array(at)) for k in range(5)), pa.array([found[i].tobytes() for i in at], pa.binary())], names=names + ["shingles"])

    wide = "family long, own int, blocks int, id long, copies long"
    alone = wanted.groupBy("first").agg(F.count("*").alias("same")).filter("same = 1 and first is not null").select("first")
    by_id = wanted.join(alone, "first")
    if wanted.count() <= 200_000:  # 64 bytes a row
        by_id = F.broadcast(by_id)
    own = ["family", "own", "blocks", "id", "copies"]
    members = read.join(by_id, read["doc_id"] == by_id["first"]).select("text", "key", *own).mapInArrow(tidy(sets), wide + ", shingles binary")
    shared = materialise(wanted.join(alone, "first", "left_anti"), "members-shared")
    if shared.limit(1).count():  # ids that stand on several texts, and null ones: these meet by their sets

        def keyed(stream):
            for batch in stream:
                for a, b in batches(batch.column(0), 2_000_000):
                    found = [s for s in shingle_sets(batch.column(0).slice(a, b - a), size) if len(s)]
                    yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["key", "shingles"])

        ids = shared.select(F.col("first").alias("i")).distinct()
        texts = read.join(ids, read["doc_id"].eqNullSafe(ids["i"]), "left_semi").select("text").mapInArrow(tidy(keyed), "key binary, shingles binary")
        members = members.union(texts.join(shared, "key").select(*own, "shingles"))
    folder = shared_dir(spark, "blocks")
    members = materialise(members.select(*own, "shingles"), "sets")
    written, large = [members], members.filter("blocks > 1")
    many = wanted.filter("blocks > 1").select("family", "blocks").distinct()
    if many.limit(1).count():
        written.append(materialise(_parted(large, threshold, block, block_shingles), "sets"))
        members = members.filter("blocks = 1").union(written[1])
        many = materialise(written[1].filter("blocks > 1").select("family", "blocks").distinct(), "many")
    verified = materialise(_within(members, threshold, folder), "links")
    discard(*written)
    pairs = many.select("family", "blocks", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("hi")).select("family", F.explode(F.sequence(F.lit(0), F.col("hi") - 1)).alias("lo"), "hi")
    verified = verified.union(materialise(_between(pairs, threshold, folder), "links"))

    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(verified.filter("id != root"), "id", "root").select(F.col("node").alias("id"), F.col("component").alias("g"))
    graph = classes.select("key", "id", "first", "copies").join(links, "id", "left").join(groups, "id", "left").withColumn("g", F.coalesce("g", "id"))
    heads = graph.groupBy("g").agg(F.min("first").alias("class_id"))
    table = graph.join(heads, "g").select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), "class_id")
    out = described.select("doc_id", "key", "n")
    some = out.filter("key is not null").join(table, "key").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.col("copies").cast("long").alias("copies"),
        (F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"),
        "class_id",
        F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"),
    )
    none = out.filter("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return some.union(none)
