"""Which stages of a build run again: by the version of each stage and a hash of
what it reads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    name: str
    version: int
    reads: tuple[str, ...] = ()  # names of inputs, or of stages before


def content_hash(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order: counts and sums of row
    hashes, made on the executors."""
    row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(df.columns)])
    n, total, mix = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return f"{n}-{total or 0}-{mix or 0}"


def plan(stages: Sequence[Stage], inputs: dict[str, str], last: dict[str, tuple[int, str]]) -> list[tuple[str, str]]:
    """(stage, reason) of what has to run, in order. ``last`` has, by stage, the
    version and the joined hashes of its last run: a stage runs if it is new, its
    version or an input changed, or a stage that it reads runs."""
    out: dict[str, str] = {}
    known = {s.name for s in stages}
    for s in stages:
        seen = state(s, inputs)
        if s.name not in last:
            out[s.name] = "new"
        elif last[s.name][0] != s.version:
            out[s.name] = "version"
        elif last[s.name][1] != seen:
            out[s.name] = "input"
        elif before := [r for r in s.reads if r in known and r in out]:
            out[s.name] = f"after {before[0]}"
    return list(out.items())


def state(stage: Stage, inputs: dict[str, str]) -> str:
    """The joined hashes of a stage's inputs, to be kept with its version."""
    return "|".join(f"{r}={inputs[r]}" for r in stage.reads if r in inputs)


def changed_rows(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Keys to work on again: (key, change) of rows that are new, gone, or
    differ in any column."""
    columns = [c for c in new.columns if c != key]
    hashed = lambda df, name: df.select(key, F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in columns]).alias(name))
    j = hashed(new, "n").join(hashed(old, "o"), key, "full")
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").when(F.col("n") != F.col("o"), "changed")
    return j.select(key, change.alias("change")).filter("change is not null")
