"""Byte-level BPE by a sentencepiece model made directly from a vocabulary.

Every byte is mapped to a printable character, each vocabulary entry becomes a
piece of those characters with the negative rank as its score, and the
normaliser is the identity. Sentencepiece merges the pair of the best score,
which is the pair of the lowest rank; a pre-token that is an entry itself gets
its rank at once. Decoding maps ids to the bytes of their entries.

Cases: a null text counts as empty; an empty text has no ids; an empty table
gives no row; repeated rows and null ids come back as they are; columns of
other names are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.llm.caches import claim, tidy
from lumenlit.llm.pieces import PieceTable, batches

#: Pre-tokens by which texts may be cut into pieces.
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """A character for each byte: printable Latin-1 stands for itself, the
    others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0x100
    for b in range(256):
        out.append(chr(b if b in own else more))
        more += b not in own
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _varint(x: int) -> bytes:
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes([*out, x])


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; the id of a piece is its rank, the unknown piece
    comes after all of them and is never used, as every byte has a piece."""
    to, body = byte_chars(), []
    order = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in order] != list(range(len(order))):
        raise ValueError("ranks must be 0 to n-1")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte needs a rank")
    for token, rank in order:
        piece = "".join(to[b] for b in token).encode()
        body.append(_field(1, _field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank)))
    body.append(_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _varint(3 << 3) + _varint(2)))
    n = len(order)
    minus = _varint((1 << 64) - 1)
    trainer = _varint(3 << 3) + _varint(2) + _varint(4 << 3) + _varint(n + 1) + _varint(40 << 3) + _varint(n)
    trainer += b"".join(_varint(k << 3) + minus for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_varint(k << 3) + b"\0" for k in (3, 4, 5))
    return b"".join(body) + _field(2, trainer) + _field(3, normaliser)


class Bpe:
    """Encoder and decoder for one vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.find, self.whole = regex.compile(pattern).findall, ranks
        self.chars = {b: c for b, c in enumerate(byte_chars())}
        self.token = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.pieces = PieceTable(self._encode_many, max_chars=30_000_000, marks=(), cut=pattern == _PLAIN)

    def _encode_many(self, many: list[str]) -> list[list[int]]:
        split = [[p.encode("utf-8", "surrogatepass") for p in self.find(x)] for x in many]
        known = {p: [self.whole[p]] for parts in split for p in parts if p in self.whole}
        rest = list({p for parts in split for p in parts if p not in known})
        known.update(zip(rest, self.model.encode([p.decode("latin-1").translate(self.chars) for p in rest], out_type=int, num_threads=1) if rest else []))
        return [[i for p in parts for i in known[p]] for parts in split]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (Arrow, or a list) one after another, and the number
        of each."""
        return self.pieces.encode(texts)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def bpe_for(ranks_path: str, pattern: str) -> Bpe:
    held, key = claim("bpe"), (ranks_path, pattern)
    if key not in held:
        held[key] = Bpe(read_ranks(ranks_path), pattern)
    return held[key]


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = True) -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens; with ``ids`` the token ids;
    with ``digests`` the hex sha256 of the decimal ids joined by a space, and of
    the bytes decoded from them."""
    kind = "doc_id long, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(stream):
        own = bpe_for(ranks_path, pattern)
        decimal = [str(i) for i in range(len(own.token))]
        for batch in stream:
            texts, keys = batch.column(1).cast(pa.string()), batch.column(0)
            for a, b in batches(texts, 2_000_000):
                flat, n = own.encode(texts.slice(a, b - a))
                columns = [keys.slice(a, b - a), pa.array(n, pa.int64())]
                ends = np.concatenate(([0], np.cumsum(n)))
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))))
                if digests:
                    first, second = [], []
                    for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
                        doc = flat[x:y].tolist()
                        first.append(hashlib.sha256(" ".join(map(decimal.__getitem__, doc)).encode()).hexdigest())
                        second.append(hashlib.sha256(own.decode(doc)).hexdigest())
                    columns += [pa.array(first, pa.string()), pa.array(second, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens"] + ["ids"] * ids + ["ids_sha256", "decoded_sha256"] * digests)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tidy(run), kind)


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (binary): the bytes of the ids; null ids give null."""
    @F.pandas_udf("binary")
    def back(col: pd.Series) -> pd.Series:
        own = bpe_for(ranks_path, pattern)
        return col.map(lambda x: None if x is None else own.decode(x))

    return df.withColumn("decoded", back(F.col(ids_col)))
