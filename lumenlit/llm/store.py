"""Shared folders: where operators put files that every executor must see."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to Python, and that are read from a file, at once: rows of tens of KB count here.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 512}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, as a URI.

    The setting is read from the session. Only where it is unset and the master
    is this machine (tests) a local folder is chosen and set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenlit-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside are removed as each query ends: its
    result is in the shared folder by then."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """What runs inside takes few rows at once: for tables with large binary
    values, of which the usual 10,000 and 4,096 rows fill an executor."""
    before = {key: spark.conf.get(key, None) for key in _BATCHES}
    for key, rows in _BATCHES.items():
        had = int(before[key] or 0)
        spark.conf.set(key, str(min(had, rows) if had > 0 else rows))
    try:
        yield
    finally:
        for key, had in before.items():
            if had is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, had)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage,
    and lost executors cost a reread only."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    with brief_shuffles(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._lumenlit_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`materialise` wrote for these frames. Nothing that is
    still to be computed may read them."""
    for df in frames:
        discard_dir(df._lumenlit_path)


def discard_dir(uri: str) -> None:
    """Delete a folder of :func:`shared_dir`, if anything was written to it."""
    fs, path = filesystem(uri)
    with contextlib.suppress(FileNotFoundError):
        fs.delete_dir(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """Writes under a name of its own and moves to the final name on success,
    so that repeated and concurrent attempts of a task leave one whole file."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.stream = self.fs.open_output_stream(self.temp, compression=None)

    def __enter__(self):
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is not None:
            self.fs.delete_file(self.temp)
            return
        try:
            self.fs.move(self.temp, self.path)
        except OSError:  # some file systems don't move over a file: another attempt of the task was first
            if self.fs.get_file_info(self.path).type != pafs.FileType.File:
                raise
            self.fs.delete_file(self.temp)


def read_file(uri: str):
    """A seekable input file."""
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
