"""Readers and writers of stage files, tables and exports."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlit.functions.text import bibtex_escape, stable_id


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file under a declared schema; blank lines are no rows."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Spark's commit protocol makes the folder appear whole or not at all."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; nulls become empty cells."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").csv(path)


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; if the target is there already the source goes."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(target)):
        fs.delete(path(source), True)
    elif not fs.rename(path(source), path(target)):
        raise OSError(f"{source} can't be moved to {target}")


def write_revision(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]], refs: list[tuple[str, str, str, str]]) -> str:
    """Write tables under ``path/<id>``, where the id is their content hash.

    Tables are written once, beside their place. There keys must be unique and
    references (table, column, other table, other column) must resolve; then the
    whole folder is renamed, so no half of a revision is ever seen under its id.
    """
    spark = next(iter(tables.values())).sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{staged}/{name}")
    held = {name: spark.read.schema(df.schema).parquet(f"{staged}/{name}") for name, df in tables.items()}
    for name, cols in keys.items():
        if held[name].groupBy(*cols).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{name}: repeated key {cols}")
    for name, col, other, key in refs:
        lost = held[name].filter(F.col(col).isNotNull()).join(held[other].select(F.col(key).alias(col)), col, "left_anti")
        if lost.limit(1).count():
            raise ValueError(f"{name}.{col} has values that are not in {other}.{key}")
    parts = [f"{n}:{content_hash(df)}" for n, df in sorted(held.items())]
    revision = hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]
    _move(spark, staged, f"{path}/{revision}")
    return revision


def row_hash(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])), 256)


def content_hash(df: DataFrame) -> str:
    """The same for the same rows in any order: row hashes are added up as
    numbers, in parts, so no list of them is gathered."""
    h = row_hash(df)
    sums = [F.coalesce(F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"s{i}") for i in range(8)]
    return "-".join(map(str, df.agg(F.count("*"), *sums).first()))


def dump_json(path: str, obj, indent: int = 2) -> None:
    """A small result as a readable JSON file, whole or not at all: written
    beside its place and moved there."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(beside, "w", encoding="utf-8") as f:
        json.dump(obj, f, ensure_ascii=False, indent=indent)
    os.replace(beside, path)


def nest(observations: DataFrame, uses: DataFrame) -> DataFrame:
    """Re-nested records: an observation with its uses in order."""
    inner = uses.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("benchmark_id", "role", "n_evidence"))).alias("uses"))
    return observations.join(inner, "obs_id", "left")


def unnest(records: DataFrame) -> DataFrame:
    return records.select("obs_id", F.inline("uses"))


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def distinct_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row for each key; a key with two names is an error."""
    if df.groupBy(key).agg(F.count_distinct(name).alias("n")).filter("n > 1").limit(1).count():
        raise ValueError(f"{key}: one id, several names")
    return df.dropDuplicates([key])


# --- BibTeX ---------------------------------------------------------------------------------------------------------


class _Bibliography:
    """Reads BibTeX with a cursor: entries, @string names, values joined by #.
    An entry that isn't well-formed is left out, and reading goes on at the next
    line that begins with an @."""

    def __init__(self, text: str):
        self.text, self.at, self.names = text, 0, {}

    def peek(self) -> str:
        """The next character that is no white space."""
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def expect(self, marks: str) -> str:
        c = self.peek()
        if not c or c not in marks:
            raise ValueError(f"one of {marks} expected at {self.at}")
        self.at += 1
        return c

    def word(self) -> str:
        self.peek()
        begin = self.at
        while self.at < len(self.text) and not (self.text[self.at].isspace() or self.text[self.at] in ',{}()="#%'):
            self.at += 1
        if begin == self.at:
            raise ValueError(f"a name expected at {begin}")
        return self.text[begin : self.at]

    def until(self, close: str) -> str:
        """The text up to this mark outside of nested braces; a backslash takes
        the meaning from what follows it."""
        out, depth = [], 0
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(self.text):
                out.append(c + self.text[self.at])
                self.at += 1
                continue
            if c == close and not depth:
                return "".join(out)
            depth += (c == "{") - (c == "}")
            out.append(c)
        raise ValueError("a value without an end")

    def value(self) -> str:
        parts = []
        while True:
            c = self.peek()
            if c in ("{", '"'):
                self.at += 1
                parts.append(self.until("}" if c == "{" else '"'))
            else:
                name = self.word()
                parts.append(self.names.get(name.lower(), name))
            if self.peek() != "#":
                return "".join(parts)
            self.at += 1

    def fields(self, close: str) -> dict[str, str]:
        out = {}
        while self.peek() != close:
            name = self.word().lower()
            self.expect("=")
            out[name] = self.value()
            if self.peek() != close:
                self.expect(",")
        self.at += 1
        return out

    def entries(self):
        while (start := self.text.find("@", self.at)) >= 0:
            self.at = start + 1
            try:
                kind = self.word().lower()
                close = "}" if self.expect("{(") == "{" else ")"
                if kind in ("comment", "preamble"):
                    self.until(close)
                elif kind == "string":
                    self.names.update(self.fields(close))
                else:
                    key = self.word()
                    if self.peek() != close:
                        self.expect(",")
                    yield kind, key, self.fields(close)
            except ValueError:
                line = self.text.find("\n@", start + 1)
                self.at = len(self.text) if line < 0 else line + 1


def parse_bibtex(text: str) -> list[dict[str, str]]:
    """Entries of a BibTeX text: kind, key, and fields by lower-case name, their
    values without braces and with single spaces."""
    plain = lambda v: " ".join(v.replace("{", "").replace("}", "").split())
    return [{"kind": kind, "key": key} | {name: plain(v) for name, v in fields.items()} for kind, key, fields in _Bibliography(text).entries()]


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """file, key, kind, fields of every entry of the files, parsed on the
    executors a file at a time."""
    schema = pa.schema([("file", pa.string()), ("key", pa.string()), ("kind", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(stream):
        for batch in stream:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = parse_bibtex(text or "")
                fields = [[(k, v) for k, v in e.items() if k not in ("key", "kind")] for e in found]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array([e["key"] for e in found], pa.string()), pa.array([e["kind"] for e in found], pa.string()), pa.array(fields, schema[3].type)], schema=schema)

    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return pages.mapInArrow(run, "file string, key string, kind string, fields map<string,string>")


def bibtex_lines(df: DataFrame) -> DataFrame:
    """id, bibtex of rows (id, author, year, title); equal keys get a, aa, ..."""
    base = F.concat(F.regexp_replace(F.lower("author"), "[^a-z]", ""), F.col("year").cast("string"))
    rank = F.row_number().over(Window.partitionBy(base).orderBy("id"))
    key = F.concat(base, F.repeat(F.lit("a"), rank - 1))
    return df.select("id", F.format_string("@inproceedings{%s, author = {%s}, year = {%s}, title = {%s}}", key, bibtex_escape(F.col("author")), F.col("year").cast("string"), bibtex_escape(F.col("title"))).alias("bibtex"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """title, link of every entry of landed HTML listings."""
    page = spark.read.text(path, wholetext=True)
    hit = F.explode(F.regexp_extract_all("value", F.lit(r'(<a[^>]*href="[^"]*"[^>]*>[^<]+</a>)'), 1)).alias("a")
    return page.select(hit).select(F.regexp_extract("a", ">([^<]+)<", 1).alias("title"), F.regexp_extract("a", 'href="([^"]*)"', 1).alias("link"), stable_id(F.col("a")).alias("id"))
