"""Scopes: which observations a question is about."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ScopeError(ValueError):
    """The scope holds nothing, or a name in it is unknown or ambiguous."""


@dataclass
class Scope:
    """``latest`` counts only where neither an edition nor years are given;
    ``papers=None`` doesn't filter, an empty list selects nothing."""

    venue: str | None = None
    edition: str | None = None
    years: list[int] = field(default_factory=list)
    topic: str | None = None
    papers: list[int] | None = None
    latest: bool = False

    def apply(self, observations: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        df = observations
        if self.venue:
            df = df.filter(F.col("venue") == self.venue.lower())
        if self.edition:
            df = df.filter(F.col("edition") == self.edition.lower())
        if self.years:
            df = df.filter(F.col("year").isin(self.years))
        if self.latest and not self.edition and not self.years:
            df = latest_editions(df)
        if self.topic is not None:
            wanted = labels.filter(F.lower("label") == self.topic.lower()).select("paper_id").distinct()
            df = df.join(wanted, "paper_id", "left_semi")
        if self.papers is not None:
            df = df.filter(F.col("paper_id").isin(self.papers)) if self.papers else df.limit(0)
        return df

    def checked(self, observations: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """As :meth:`apply`, but nothing in scope is an error, not zero."""
        if self.topic is not None and not labels.filter(F.lower("label") == self.topic.lower()).limit(1).count():
            raise ScopeError(f"unknown topic {self.topic!r}")
        df = self.apply(observations, labels)
        if self.papers != [] and not df.limit(1).count():
            raise ScopeError("nothing in scope")
        return df


def latest_editions(observations: DataFrame) -> DataFrame:
    """Observations of the latest edition of each venue. The editions are few:
    their maxima come from a partial aggregate and are joined back."""
    last = observations.groupBy("venue").agg(F.max("edition").alias("edition"))
    return observations.join(last, ["venue", "edition"], "left_semi")


def find_entity(benchmarks: DataFrame, folded, name: str) -> DataFrame:
    """Entries under a name: by exact id if there is one, else by the folded
    name. None or several are errors."""
    exact = benchmarks.filter(F.col("id").cast("string") == name)
    found = exact if exact.limit(1).count() else benchmarks.filter(folded(F.col("name")) == folded(F.lit(name)))
    some = [r.id for r in found.select("id").orderBy("id").limit(20).collect()]
    if len(some) != 1:
        raise ScopeError(f"{name!r} is {'unknown' if not some else 'ambiguous: ' + ', '.join(map(str, some))}")
    return found
