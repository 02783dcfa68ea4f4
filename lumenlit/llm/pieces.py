"""Encoding whole texts by way of distinct pieces.

A byte-level BPE tokenizer of this family never merges across the place before
a space that is followed by a non-space character, across a line feed between
two such characters, or between a letter or digit and the marks behind it. Cut
there, a text falls into pieces whose codes simply follow one another, and most
pieces recur. Texts are cut and their words numbered in Arrow, a batch at a
time; each distinct piece is encoded once by the library and kept in a table of
bounded size; a text is then a gather from that table.

Texts in which white space follows white space, or which hold one of ``marks``
(added tokens), are given to the library whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = _SPACE + _SPACE
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
#: Last byte of a letter or digit of one byte, and of two by their first byte.
_ALNUM = np.zeros(256, bool)
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0, 0xD1]] = True  # Latin and Cyrillic letters, but for two signs


class _Places(dict):
    """Place of each key in the table; a new key gets the next one."""

    def __init__(self, table: "PieceTable", lead: str):
        super().__init__()
        self.table, self.lead = table, lead

    def __missing__(self, key: str) -> int:
        new = self.table.new
        place = self[key] = self.table.n + len(new)
        new.append(self.lead + key)
        return place


def _bytes(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and the bytes they point into."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, "<i4")[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (ends - ends[0]).astype(np.int64), raw[ends[0] : ends[-1]]


def _strings(lens: np.ndarray, data: np.ndarray) -> pa.StringArray:
    ends = np.concatenate(([0], np.cumsum(lens))).astype("<i4")
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


def cut_marks(words: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """Each word without the ASCII marks behind its last letter or digit, and
    these marks; words that can't be cut there stay whole."""
    ends, data = _bytes(words)
    lens = np.diff(ends)
    last = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data)))) if len(data) else np.zeros(0, np.int64)
    at = np.where(lens > 0, last[np.maximum(ends[1:] - 1, 0)], -1) if len(data) else np.full(len(lens), -1)
    has = at >= ends[:-1]  # a character that is no mark
    b1, b0 = data[np.maximum(at, 0)] if len(data) else lens, data[np.maximum(at - 1, 0)] if len(data) else lens
    two = _LEAD[b0] & (b1 >= 0x80) & (b1 < 0xC0) & ~((b0 == 0xC3) & ((b1 == 0x97) | (b1 == 0xB7))) & (at > ends[:-1])
    core = np.where(has & (_ALNUM[b1] | two), at + 1 - ends[:-1], lens)
    place = np.arange(len(data)) - np.repeat(ends[:-1], lens)
    inside = place < np.repeat(core, lens)
    return _strings(core, data[inside]), _strings(lens - core, data[~inside])


class PieceTable:
    """``encode_many`` gives the ids of each of a list of strings.

    ``max_chars`` bounds the characters held, where a piece counts 150 more for
    its own cost in memory; beyond it the table starts anew, which costs time
    and never changes a result. ``end`` is an id that follows every text.
    ``marks`` are the tokens that the library finds in texts before it cuts
    them; None if they aren't known, and then no marks are cut from words. With
    ``cut`` false all texts are given to the library whole.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], max_chars: int = 100_000_000, end: int | None = None, marks: tuple[str, ...] | None = None, cut: bool = True):
        self.encode_many, self.max_chars, self.end, self.marks, self.cut = encode_many, max_chars, end, marks, cut
        self._clear()

    def _clear(self) -> None:
        self.new: list[str] = []
        self.spaced, self.plain = _Places(self, " "), _Places(self, "")  # key w stands for " " + w, or for itself
        self.held, self.n, self.used = 0, 0, 0
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, np.uint32)
        self._append([[] if self.end is None else [self.end], *self.encode_many(["\n"])])  # places 0 and 1

    def _append(self, codes: list[list[int]]) -> None:
        lens = np.fromiter(map(len, codes), np.int64, len(codes))
        flat = np.fromiter(chain.from_iterable(codes), np.uint32, int(lens.sum()))
        while self.n + len(codes) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(flat)] = flat
        self.length[self.n : self.n + len(codes)] = lens
        self.start[self.n : self.n + len(codes)] = self.used + np.cumsum(lens) - lens
        self.n += len(codes)
        self.used += len(flat)

    def _learn(self) -> None:
        new, self.new = self.new, []
        for at in range(0, len(new), 4096):
            self._append(self.encode_many(new[at : at + 4096]))
        self.held += sum(map(len, new)) + 150 * len(new)

    @staticmethod
    def _gather(pool: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lens)
        first = start - (ends - lens)
        out = np.empty(int(ends[-1]) if len(ends) else 0, pool.dtype)
        for lo in range(0, len(lens), 1 << 15):  # places take more room than what they point to
            hi = min(lo + (1 << 15), len(lens))
            begin, end = int(ends[lo] - lens[lo]), int(ends[hi - 1])
            at = np.repeat(first[lo:hi], lens[lo:hi])
            at += np.arange(begin, end)
            out[begin:end] = pool[at]
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (an Arrow array or a list of strings) one after
        another, and how many each text has."""
        if self.held > self.max_chars:
            self._clear()
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        odd = np.ones(len(texts), bool)
        if self.cut:
            odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False).astype(bool)
            for mark in self.marks or ():
                odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False).astype(bool)
        if not odd.any():
            return self._encode_even(texts)
        whole, tail = texts.filter(pa.array(odd)), [] if self.end is None else [self.end]
        other, sizes = [], []
        for a, b in batches(whole, 250_000):  # the library's own results take over 100 bytes a token
            many = self.encode_many(whole.slice(a, b - a).to_pylist())
            other.append(np.fromiter((x for c in many for x in (*c, *tail)), np.uint32))
            sizes += [len(c) + len(tail) for c in many]
            del many
        ids, counts = self._encode_even(texts.filter(pa.array(~odd)))
        lens = np.empty(len(texts), np.int64)
        lens[~odd], lens[odd] = counts, sizes
        start = np.empty(len(texts), np.int64)
        start[~odd], start[odd] = np.cumsum(counts) - counts, len(ids) + np.cumsum(lens[odd]) - lens[odd]
        return self._gather(np.concatenate((ids, *other)), start, lens), lens

    def _encode_even(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        by_line = pc.split_pattern(texts, "\n")
        by_word = pc.split_pattern(by_line.flatten(), " ")
        lines, words = pc.list_value_length(by_line).to_numpy().astype(np.int64), pc.list_value_length(by_word).to_numpy().astype(np.int64)
        coded = by_word.flatten().dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary
        first = np.cumsum(words) - words  # of a line: no space before it
        plain = np.zeros(len(distinct), bool)
        plain[index[first]] = True
        spaced = np.bincount(index, minlength=len(distinct)) > np.bincount(index[first], minlength=len(distinct))
        core, tail = (x.dictionary_encode() for x in (cut_marks(distinct) if self.marks is not None else (distinct, pa.array([""] * len(distinct), pa.string()))))
        which, behind = core.indices.to_numpy(), tail.indices.to_numpy()
        names = core.dictionary
        tails = np.fromiter(map(self.plain.__getitem__, tail.dictionary.to_pylist()), np.int64, len(tail.dictionary))[behind]
        places = []
        for used, table in ((spaced, self.spaced), (plain, self.plain)):
            wanted, place = np.zeros(len(names), bool), np.zeros(len(names), np.int64)
            wanted[which[used]] = True
            place[wanted] = np.fromiter(map(table.__getitem__, names.filter(pa.array(wanted)).to_pylist()), np.int64, int(wanted.sum()))
            places.append(place[which])
        self._learn()
        # the distinct words, spaced and plain, then the end and the line feed, as a pool for this batch
        two = np.stack([np.concatenate(places), np.concatenate((tails, tails))], axis=1)
        lens2 = self.length[two]
        lens2[~np.concatenate((spaced, plain))] = 0
        flat = self._gather(self.pool, self.start[two].reshape(-1), lens2.reshape(-1))
        lens = np.concatenate((lens2.sum(axis=1), self.length[:2]))
        pool = np.concatenate((flat, self.pool[: self.start[1] + self.length[1]]))
        start = np.cumsum(lens) - lens
        n, m = len(distinct), len(words)
        item = np.empty(len(index) + m, np.int32)
        after = np.cumsum(words + 1) - 1
        slot = np.ones(len(item), bool)
        slot[after] = False
        item[slot] = index
        item[after] = 2 * n + 1  # a line feed
        ends = np.cumsum(lines) - 1
        item[after[ends]] = 2 * n
        item[np.concatenate(([0], after[:-1] + 1))] += n
        sizes = lens[item]
        done = np.cumsum(sizes)
        return self._gather(pool, start[item], sizes), np.diff(done[after[ends]], prepend=0)


def batches(texts: pa.Array, max_bytes: int = 8_000_000):
    """Ranges of ``texts`` of about ``max_bytes`` each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(size):
        done = size[begin - 1] if begin else 0
        end = min(len(size), int(np.searchsorted(size, done + max_bytes)) + 1)
        yield begin, end
        begin = end
