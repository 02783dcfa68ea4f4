"""Token-id files with random access: directly addressable codes.

A file keeps the ids of many documents one after another. Each id is cut into
chunks, low bits first; level k holds the k-th chunk of the ids that reach it,
bit-packed at that level's width, and a bitmap tells which of them go on to the
next level. A rank directory over the bitmap gives the place there, so any
token is read without decoding a block. The widths of a file are those with
the smallest total size for its own ids.

Layout: ``DACT``, the header's length (uint32), a JSON header with the place of
every section, the sections. All numbers are little-endian.

Cases: a null text counts as empty and stores the end id alone; an empty table
gives no file and no row; repeated rows are stored as often as they occur; rows
with a null id come first and come back with a null id; other columns are not
read. Equal ids are ordered by their text.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlit.llm.bpe import byte_chars
from lumenlit.llm.caches import claim, tidy
from lumenlit.llm.pieces import PieceTable, batches
from lumenlit.llm.store import AtomicFile, read_file

_RANK = 512  # bits between entries of the rank directory
_TOKENS = 8_000_000  # a file is closed once it has this many
_SLICE = 500_000  # tokens that are read at once, at up to 60 bytes each


def _widths(ids: np.ndarray) -> list[int]:
    """Chunk widths of the smallest total size, found by dynamic programming."""
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    reach = [len(ids)] + [int(np.count_nonzero(ids >> s)) for s in range(1, top)]
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)
    for s in range(top - 1, -1, -1):
        options = []
        for e in range(s + 1, top + 1):
            more = 0 if e == top else reach[s] * (1 + 32 / _RANK)
            options.append((reach[s] * (e - s) + more + best[e][0], [e - s, *best[e][1]]))
        best[s] = min(options)
    return best[0][1]


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low bits of these values."""
    out = []
    for at in range(0, len(values), 1 << 16):  # a multiple of 8 values: whole bytes
        v = values[at : at + (1 << 16)].astype("<u4")
        bits = np.unpackbits(v.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=width)
        out.append(np.packbits(bits.reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def _unpack(data: np.ndarray, width: int, begin: int, end: int) -> np.ndarray:
    first = begin * width
    bits = np.unpackbits(data[first // 8 : (end * width + 7) // 8], bitorder="little")
    bits = bits[first % 8 : first % 8 + (end - begin) * width].reshape(-1, width)
    full = np.zeros((end - begin, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


def dac_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of these documents; ``counts`` gives the ids of each."""
    sections: dict[str, bytes] = {
        "doc_id": np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        "has_id": np.array([x is not None for x in doc_ids], np.uint8).tobytes(),
        "end": np.cumsum(counts).astype("<i8").tobytes(),
    }
    widths, rest = _widths(ids), ids.astype(np.uint32, copy=False)
    for k, width in enumerate(widths):
        sections[f"chunk{k}"] = _pack(rest, width)
        if k + 1 < len(widths):
            more = (rest >> np.uint32(width)) > 0
            sections[f"more{k}"] = np.packbits(more, bitorder="little").tobytes()
            ones = np.add.reduceat(more, np.arange(0, len(more), _RANK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
            sections[f"rank{k}"] = (np.cumsum(ones) - ones).astype("<u4").tobytes()
            rest = rest[more] >> np.uint32(width)
    places, at = {}, 0
    for name, data in sections.items():
        places[name] = [at, len(data)]
        at += len(data)
    head = json.dumps({"version": 1, "n_docs": len(doc_ids), "n_tokens": int(len(ids)), "widths": widths, "sections": places}).encode()
    return b"DACT" + len(head).to_bytes(4, "little") + head + b"".join(sections.values())


class DacFile:
    """Reader of one file. Sections are mapped on first use; :meth:`token`
    touches a few bytes of each level only."""

    def __init__(self, uri: str):
        self.file = read_file(uri)
        if self.file.read(4) != b"DACT":
            raise ValueError(f"{uri} is not a token file")
        size = int.from_bytes(self.file.read(4), "little")
        self.head = json.loads(self.file.read(size))
        self.base, self._kept = 8 + size, {}
        self.widths, self.n_tokens = self.head["widths"], self.head["n_tokens"]

    def _section(self, name: str, kind=np.uint8) -> np.ndarray:
        if name not in self._kept:
            at, size = self.head["sections"][name]
            self._kept[name] = np.frombuffer(self.file.read_at(size, self.base + at), kind)
        return self._kept[name]

    def _bytes(self, name: str, begin: int, end: int) -> bytes:
        at, size = self.head["sections"][name]
        return self.file.read_at(max(0, min(end, size) - begin), self.base + at + begin)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents, and the end of each in tokens."""
        ids, has = self._section("doc_id", "<i8").tolist(), self._section("has_id")
        return [x if h else None for x, h in zip(ids, has)], self._section("end", "<i8")

    def token(self, i: int) -> int:
        """The i-th id of the file, by one step for each level it reaches."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for k, width in enumerate(self.widths):
            first = i * width
            raw = int.from_bytes(self._bytes(f"chunk{k}", first // 8, (first + width + 7) // 8), "little")
            value |= (raw >> first % 8 & (1 << width) - 1) << shift
            shift += width
            if k + 1 == len(self.widths):
                break
            block = i // _RANK
            bits = int.from_bytes(self._bytes(f"more{k}", block * _RANK // 8, i // 8 + 1), "little")
            if not bits >> i - block * _RANK & 1:
                break
            before = int.from_bytes(self._bytes(f"rank{k}", 4 * block, 4 * block + 4), "little")
            i = before + (bits & (1 << i - block * _RANK) - 1).bit_count()
        return value

    def _rank(self, k: int, i: int) -> int:
        """Set bits of level k before place i."""
        block = i // _RANK
        ranks = self._section(f"rank{k}", "<u4")
        if block >= len(ranks):
            block = len(ranks) - 1
        if block < 0:
            return 0
        bits = np.unpackbits(self._section(f"more{k}")[block * _RANK // 8 : (i + 7) // 8], bitorder="little", count=i - block * _RANK)
        return int(ranks[block]) + int(bits.sum())

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end`` of the file."""
        out, shift = np.zeros(end - begin, np.uint32), 0
        where = np.arange(end - begin)
        for k, width in enumerate(self.widths):
            if not len(where):
                break
            out[where] |= _unpack(self._section(f"chunk{k}"), width, begin, end) << np.uint32(shift)
            shift += width
            if k + 1 < len(self.widths):
                more = np.unpackbits(self._section(f"more{k}")[begin // 8 : (end + 7) // 8], bitorder="little")[begin % 8 : begin % 8 + end - begin].astype(bool)
                begin = self._rank(k, begin)
                where = where[more]
                end = begin + len(where)
        return out


class _Words:
    """Encodes pieces by the tokenizers library. A piece of letters is one
    pre-token and goes to the library's BPE model at once; all others go through
    the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.model = self.own.model.tokenize
        self.chars = dict(enumerate(byte_chars()))
        steps = json.loads(self.own.to_str())
        pre = steps.get("pre_tokenizer") or {}
        #: only where the file has plain byte-level pre-tokens and nothing else
        self.plain = steps["model"].get("type") == "BPE" and steps.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        self.added = tuple(t["content"] for t in steps.get("added_tokens") or [])

    def __call__(self, many: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(many)
        rest, model, chars = [], self.model, self.chars
        for i, piece in enumerate(many):
            if self.plain and (piece[1:] if piece[:1] == " " else piece).isalpha() and piece not in self.added:
                out[i] = [t.id for t in model(piece.encode().decode("latin-1").translate(chars))]
            else:
                rest.append(i)
        for i, e in zip(rest, self.own.encode_batch_fast([many[i] for i in rest], add_special_tokens=False) if rest else []):
            out[i] = e.ids
        return out


def piece_table(tokenizer_path: str, end_id: int | None) -> PieceTable:
    """Of a tokenizer file. Where its pre-tokens aren't plain byte-level ones,
    texts are encoded whole, as those are that hold an added token."""
    words = _Words(tokenizer_path)
    return PieceTable(words, end=end_id, marks=words.added, cut=words.plain)


def _table(tokenizer_path: str, end_id: int) -> PieceTable:
    """One table for each Python worker: later tasks use what earlier ones met."""
    held, key = claim("token_store"), (tokenizer_path, end_id)
    if key not in held:
        held[key] = piece_table(tokenizer_path, end_id)
    return held[key]


def write_token_store(df: DataFrame, out: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokens_per_file: int = _TOKENS) -> DataFrame:
    """Encode ``df`` into files below ``out`` in ascending id order.

    Texts, not ids, are dealt into ranges of ``id_col``: they are smaller, and
    sampling the ranges then reads ids only. Returns one row per file (uri,
    part, seq, n_docs, n_tokens, start), start being the ids of all files before.
    """
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    dealt = rows.repartitionByRange("i").sortWithinPartitions("i", "t")

    def write(stream):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        table = _table(tokenizer_path, end_id)
        docs: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def close():
            uri = f"{out}/part-{part:06d}-{seq:04d}.dac"
            flat = np.concatenate(ids)
            ids.clear()
            with AtomicFile(uri) as f:
                f.write(dac_bytes(docs, np.concatenate(counts), flat))
            return pa.RecordBatch.from_pylist([{"uri": uri, "part": part, "seq": seq, "n_docs": len(docs), "n_tokens": held}], schema=pa.schema([("uri", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in stream:
            texts, keys = batch.column(1).cast(pa.string()), batch.column(0)
            for a, b in batches(texts, 4_000_000):
                flat, n = table.encode(texts.slice(a, b - a))
                docs += keys.slice(a, b - a).to_pylist()
                counts.append(n)
                ids.append(flat)
                held += len(flat)
                if held >= tokens_per_file:
                    yield close()
                    seq, held = seq + 1, 0
                    docs, counts, ids = [], [], []
        if docs:
            yield close()

    spark = df.sparkSession
    manifest = f"{out}/manifest"
    dealt.mapInArrow(tidy(write), "uri string, part long, seq long, n_docs long, n_tokens long").write.parquet(manifest)
    files = spark.read.parquet(manifest).orderBy("part", "seq").collect()  # one row for each file of millions of ids
    start, listed = 0, []
    for f in files:
        listed.append((*f, start))
        start += f.n_tokens
    return spark.createDataFrame(listed, "uri string, part long, seq long, n_docs long, n_tokens long, start long")


def stored(own: DacFile):
    """Lists of the documents of a file, at most 2,000 each: ids, begins and ends
    in tokens, crc32 of their ids. No more than ``_SLICE`` tokens are held."""
    docs, ends = own.documents()
    lo = at = 0
    while lo < len(docs):
        hi = min(lo + 2000, max(lo + 1, int(np.searchsorted(ends, at + _SLICE, side="right"))))
        cuts = np.concatenate(([at], ends[lo:hi]))
        crc = [0] * (hi - lo)
        if hi == lo + 1:  # may be longer
            for x in range(at, int(cuts[1]), _SLICE):
                crc[0] = zlib.crc32(own.slice(x, min(x + _SLICE, int(cuts[1]))).astype("<u4").tobytes(), crc[0])
        else:
            ids = own.slice(at, int(cuts[-1])).astype("<u4")
            crc = [zlib.crc32(ids[a - at : b - at].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        yield docs[lo:hi], cuts[:-1], cuts[1:], crc
        lo, at = hi, int(cuts[-1])


def read_token_store(files: DataFrame) -> DataFrame:
    """One row per stored document, read from the files: doc_id, start (ids of
    all documents before it), n_tokens and the crc32 of its ids."""

    def read(stream):
        claim("token_read")  # the pieces of the encoder are spent
        for batch in stream:
            for f in batch.to_pylist():
                for docs, begins, ends, crc in stored(DacFile(f["uri"])):
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(f["start"] + begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(files.count(), 10_000))
    return files.repartition(n, "uri").mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(spark: SparkSession, df: DataFrame, out: str, tokenizer_path: str, **options) -> DataFrame:
    """Write, then read back."""
    return read_token_store(write_token_store(df, out, tokenizer_path, **options))
