"""Names in texts: longest-match scan, acronyms, homonyms."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Finder:
    """Names of up to ``most`` words, found longest first and without overlap."""

    def __init__(self, names: dict[str, int], most: int = 5):
        self.names = {tuple(n.split()): i for n, i in names.items() if 0 < len(n.split()) <= most}
        self.starts = {n[:k] for n in self.names for k in range(1, len(n) + 1)}

    def find(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(first word, number of words, id), left to right."""
        out, at = [], 0
        while at < len(words):
            best, n = None, 0
            while at + n < len(words) and tuple(words[at : at + n + 1]) in self.starts:
                n += 1
                if tuple(words[at : at + n]) in self.names:
                    best = n
            if best:
                out.append((at, best, self.names[tuple(words[at : at + best])]))
                at += best
            else:
                at += 1
        return out


def scan_names(texts: DataFrame, names: dict[str, int]) -> DataFrame:
    """id, name_id, hits, first (word) of each name in each text. The names are
    a vocabulary of fixed size that goes with the tasks."""
    finder = Finder(names)
    schema = pa.schema([("id", pa.int64()), ("name_id", pa.int64()), ("hits", pa.int64()), ("first", pa.int64())])

    def run(stream):
        for batch in stream:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found: dict[int, list[int]] = {}
                for at, _, name in finder.find(re.findall(r"[a-z0-9]+", (t or "").lower())):
                    found.setdefault(name, []).append(at)
                rows += [{"id": i, "name_id": n, "hits": len(w), "first": w[0]} for n, w in found.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return texts.select("id", "text").mapInArrow(run, "id long, name_id long, hits long, first long")


def is_acronym_of(short: str, long: str) -> bool:
    """The capitals of the short form follow initials of the long form in order."""
    initials = iter(w[0].upper() for w in re.findall(r"\w+", long))
    caps = [c for c in short if c.isupper()]
    return len(caps) >= 2 and all(any(c == i for i in initials) for c in caps)


def resolve_homonyms(mentions: DataFrame, candidates: DataFrame, titles: DataFrame, least: int = 12) -> DataFrame:
    """A mention (mention_id, key, cites) goes to the one candidate (key, id)
    whose introducing title (id, title) its sentence cites; else to none."""
    alone = candidates.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("only"))
    cited = candidates.join(titles, "id").filter(F.length("title") >= least)
    hits = mentions.join(cited, "key").filter(F.col("cites").contains(F.col("title"))).groupBy("mention_id").agg(F.count_distinct("id").alias("m"), F.min("id").alias("hit"))
    rows = mentions.join(alone, "key", "left").join(hits, "mention_id", "left")
    return rows.select("mention_id", F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("hit")).alias("id"), F.when(F.col("n").isNull(), "unknown").when((F.col("n") == 1) | (F.col("m") == 1), "attributed").otherwise("homonym").alias("outcome"))
