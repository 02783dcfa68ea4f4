"""Figures of an answer against the facts its tools returned."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?")
# Signs that stand for a minus, and what ends a clause.
MINUS = "−–‐‑"
CLAUSE = ".;!?\n"
_ROWS = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("raw", pa.string()), ("value", pa.float64()), ("places", pa.int32()), ("unit", pa.string()), ("clause", pa.string()), ("quoted", pa.bool_()), ("anchor", pa.string())])


def _is_name(text: str, at: int, end: int) -> bool:
    """The digits belong to a name or a year, not to a count."""
    before, after = text[:at], text[end:]
    if re.fullmatch(r"(?:19|20)\d\d", text[at:end]):
        return True
    return bool(re.search(r"[A-Za-z][-_/]?$", before) or re.match(r"[A-Za-z]", after))


def figures_of(text: str) -> list[tuple]:
    """(place, raw, value, decimal places, unit, clause, quoted, anchor) of
    every figure. Unit: ``%``, or the word behind it without a plural s. Anchor:
    ``tool:arguments`` in double brackets around the figure."""
    text = text.translate({ord(c): "-" for c in MINUS})
    anchors = [(m.start(), m.end(), m[1].strip()) for m in re.finditer(r"\[\[([^\]|]+)\|[^\]]*\]\]", text)]
    quotes = [(m.start(), m.end()) for m in re.finditer(r"[\"“][^\"”]*[\"”]", text)]
    out = []
    for m in _NUMBER.finditer(text):
        at, end = m.span()
        inside = next((a for lo, hi, a in anchors if lo <= at < hi), None)
        if inside is not None and at < text.index("|", next(lo for lo, hi, a in anchors if lo <= at < hi)):
            continue  # of the anchor's own arguments
        if _is_name(text, at, end):
            continue
        raw = m[0].replace(",", "")
        unit = re.match(r"\s*(%|percent\b|[A-Za-z][A-Za-z-]*)", text[end:])
        word = "" if unit is None else "%" if unit[1] in ("%", "percent") else unit[1].lower().removesuffix("s")
        lo = max((text.rfind(c, 0, at) for c in CLAUSE), default=-1) + 1
        hi = min((k for c in CLAUSE if (k := text.find(c + " " if c == "." else c, end)) >= 0), default=len(text))
        out.append((at, raw, float(raw), len(raw.partition(".")[2]), word, text[lo:hi].strip().lower(), any(a <= at < b for a, b in quotes), inside))
    return out


def figures(answers: DataFrame) -> DataFrame:
    """One row for each figure of answers (id, text); null texts have none."""

    def run(stream):
        for batch in stream:
            rows = [(i, *f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for f in figures_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS)], schema=_ROWS)

    return answers.select("id", "text").mapInArrow(run, "id long, at long, raw string, value double, places int, unit string, clause string, quoted boolean, anchor string")


def rounds_to(value: Column, places: Column, fact: Column) -> Column:
    """The fact, at the precision at which the value is printed, is the value."""
    scale = F.pow(F.lit(10.0), places)
    return F.rint(fact * scale) == F.rint(value * scale)


def derived(values: DataFrame, most: int = 120) -> DataFrame:
    """Numbers (turn, value, places) that a reader gets from two facts of a turn:
    sums, differences, shares and quotients, rounded to 0, 1 and 2 places. The
    ``most`` smallest distinct facts of a turn take part: that bound is the
    rule's own."""
    own = values.groupBy("turn").agg(F.slice(F.array_sort(F.collect_set("value")), 1, most).alias("v"))
    a = own.select("turn", "v", F.posexplode("v").alias("i", "a"))
    pairs = a.select("turn", "a", F.explode(F.expr("slice(v, i + 2, size(v))")).alias("b"))
    made = F.array(F.col("a") - F.col("b"), F.col("b") - F.col("a"), F.col("a") + F.col("b"), F.try_divide("a", "b") * 100, F.try_divide("b", "a") * 100, F.try_divide("a", "b"), F.try_divide("b", "a"))
    flat = pairs.select("turn", F.explode(made).alias("c")).filter("c between 0 and 1e7")
    return flat.select("turn", F.explode(F.array(*[F.struct(F.rint(F.col("c") * 10**p).alias("scaled"), F.lit(p).alias("places")) for p in range(3)])).alias("x")).select("turn", "x.scaled", "x.places").distinct()


def verdicts(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Figures (turn, id, at, value, places, ...) against facts (turn, value):
    ok, derived from two, or no."""
    for_p = facts.select("turn", F.explode(F.array(*[F.struct(F.rint(F.col("value") * 10**p).alias("scaled"), F.lit(p).alias("places")) for p in range(7)])).alias("x")).select("turn", "x.scaled", "x.places").distinct().withColumn("ok", F.lit(True))
    made = derived(facts).withColumn("made", F.lit(True))
    j = found.withColumn("scaled", F.rint(F.col("value") * F.pow(F.lit(10.0), F.col("places")))).join(for_p, ["turn", "places", "scaled"], "left").join(made, ["turn", "places", "scaled"], "left")
    return j.withColumn("verdict", F.when(F.col("ok"), "ok").when(F.col("made"), "derived").otherwise("no")).drop("scaled", "ok", "made")


def connected_verdicts(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Figures (turn, id, at, value, places, unit, clause) against facts (turn,
    subject, measure, value): a fact speaks for a figure if it rounds to it, its
    measure is the figure's unit (or the figure has none that any fact of the
    turn measures), and its subject stands in the clause or is the turn's only
    one. Verdicts: ok, misplaced (the number is there, for something else), no.
    """
    measures = facts.groupBy("turn").agg(F.collect_set("measure").alias("measures"), F.count_distinct("subject").alias("subjects"))
    number = found.join(facts, "turn").filter(rounds_to(found["value"], found["places"], facts["value"])).join(measures, "turn")
    unit = F.when(F.array_contains("measures", F.col("unit")), F.col("measure") == F.col("unit")).otherwise(F.lit(True))
    subject = (F.col("subject") == "") | F.col("clause").contains(F.lower("subject")) | (F.col("subjects") == 1)
    best = number.groupBy("turn", "id", "at").agg(F.bool_or(unit & subject).alias("speaks"))
    return found.join(best, ["turn", "id", "at"], "left").withColumn("verdict", F.when(F.col("speaks"), "ok").when(F.col("speaks").isNotNull(), "misplaced").otherwise("no")).drop("speaks")


def anchored(found: DataFrame, calls: DataFrame) -> DataFrame:
    """Figures with an anchor against the calls (turn, call, value) that the
    turn made: ok, no, or na where the turn made no such call."""
    called = calls.select("turn", F.col("call").alias("anchor")).distinct().withColumn("called", F.lit(True))
    hit = found.join(calls.select("turn", F.col("call").alias("anchor"), F.col("value").alias("fact")), ["turn", "anchor"]).filter(rounds_to(F.col("value"), F.col("places"), F.col("fact"))).select("turn", "id", "at").distinct().withColumn("hit", F.lit(True))
    j = found.filter("anchor is not null").join(called, ["turn", "anchor"], "left").join(hit, ["turn", "id", "at"], "left")
    return j.withColumn("state", F.when(F.col("called").isNull(), "na").when(F.col("hit"), "ok").otherwise("no")).drop("called", "hit")


def segments(answers: DataFrame) -> DataFrame:
    """Answers (id, text) cut into pieces (id, pos, kind, text): anchors,
    quotes, and the prose between them, in order."""
    parts = F.regexp_extract_all("text", F.lit(r"(\[\[[^\]|]+\|[^\]]*\]\]|[\"“][^\"”]*[\"”]|(?:(?!\[\[)[^\"“”])+)"), 1)
    p = answers.select("id", F.posexplode(parts).alias("pos", "text"))
    kind = F.when(F.col("text").startswith("[["), "anchor").when(F.substring("text", 1, 1).isin('"', "“"), "quote").otherwise("prose")
    return p.select("id", F.col("pos").cast("long").alias("pos"), kind.alias("kind"), "text").filter("text != ''")
