"""Mixing documents to target weights by iterative proportional fitting.

Token counts are summed by source, language and topic. The fit rakes these
weights until the margins match their targets: a factor for every source, one
for every language, one for every topic. A document's probability is its cell's
fitted weight over the cell's tokens, scaled so that the expected tokens are
``share`` of all, and at most 1. A document is kept if a uniform number made
from its id lies below its probability.

Sources may be without number: their factors stay in a table, a row for each
source with its cells, and a sweep is one pass over it. The factors of languages
and topics are kept by the driver while there are at most ``max_pairs`` pairs of
these; beyond, all factors are tables, and a sweep joins and sums three times.

All of it runs in DataFrame functions. Sums of weights are decimal, so that
neither tasks nor retries change a bit of them. A fit whose margins are off by
more than ``tolerance`` of a target after the last sweep gives a warning.

Cases: null sources, languages and topics count as the empty string; a null
text has no tokens; cells without tokens get probability 1; rows of one id are
kept or dropped together, and a null id counts as the empty string; an empty
table stays empty; columns of ``docs`` pass through untouched, whatever their
names.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.llm.store import discard, materialise

_WORD = r"[^\x09-\x0D\x20]+"
_SCALE = 2**52


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def shape_topic(text: Column, tokens: Column) -> Column:
    """A topic by the shape of a text: table, marked, note or prose."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.instr(t, " | ") > 0, "table").when(F.instr(t, "***") > 0, "marked").when(tokens < 40, "note").otherwise("prose")


def uniform(id_text: Column, seed: str) -> Column:
    """A number from 0 to 1 made from an id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_text, F.lit("")))), 1, 13), 16, 10).cast("double") / _SCALE


def _sum(weight: Column) -> Column:
    """In decimals: the order of rows does not matter."""
    return F.coalesce(F.sum(weight.cast("decimal(38,10)")).cast("double"), F.lit(0.0))


def _off(residual: float, tolerance: float) -> None:
    if residual > tolerance:
        warnings.warn(f"margins are off by up to {residual:.2%} of their targets", stacklevel=3)


def _rake(cells: DataFrame, powers: tuple[float, float, float], sweeps: int, total: float, tolerance: float) -> DataFrame:
    """Rows (s, l, t, n, r) of cells: r is the fitted weight over the tokens."""
    wants = []
    for key, power in zip("slt", powers):
        want = cells.groupBy(key).agg(F.pow(F.sum("n"), F.lit(power)).alias("want"))
        scale = total / want.agg(_sum(F.col("want"))).first()[0]
        wants.append(materialise(want.select(key, (F.col("want") * scale).alias("want")), "mix-want"))
    now = cells.withColumn("w", F.col("n"))
    for _ in range(sweeps):
        for key, want in zip("slt", wants):
            ratio = now.groupBy(key).agg(_sum(F.col("w")).alias("sum")).join(want, key).select(key, (F.col("want") / F.col("sum")).alias("ratio"))
            last, now = now, materialise(now.join(ratio, key).select("s", "l", "t", "n", (F.col("w") * F.col("ratio")).alias("w")), "mix-raked")
            if hasattr(last, "_lumenlit_path"):
                discard(last)
    residual = [now.groupBy(key).agg(_sum(F.col("w")).alias("sum")).join(want, key).agg(F.max(F.abs(F.col("sum") / F.col("want") - 1))).first()[0] for key, want in zip("sl", wants)]
    _off(max(residual), tolerance)
    return materialise(now.select("s", "l", "t", "n", (F.col("w") / F.col("n")).alias("r")), "mix-rates")


def _cap(rates: DataFrame, share: float, total: float, steps: int) -> float:
    """The scale by which the expected tokens are ``share`` of all: beyond
    probability 1 a cell gives no more, and the others make up for it."""
    scale = share
    for _ in range(steps):
        capped = F.col("r") * F.lit(scale) >= 1
        full, rest = rates.agg(F.coalesce(F.sum(F.when(capped, F.col("n"))), F.lit(0.0)), _sum(F.when(~capped, F.col("n") * F.col("r")))).first()
        if not rest:
            break
        scale = (share * total - full) / rest
    return scale


def _lookup(factors: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in sorted(factors.items()) for x in kv]), key)


def mix_to_targets(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    lang_col: str = "lang",
    text_col: str = "text",
    topic: Callable[[Column, Column], Column] = shape_topic,
    share: float = 0.6,
    powers: tuple[float, float, float] = (0.7, 0.7, 0.9),
    sweeps: int = 10,
    steps: int = 6,
    seed: str = "mix",
    max_pairs: int = 4096,
    tolerance: float = 0.05,
    details: bool = False,
) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``.

    Targets are the margins of source, language and topic raised to ``powers``
    (below 1 lifts the rare ones). With ``details``: doc_id, source, lang,
    topic, n_tokens and prob of the documents that are kept, instead.
    """
    own = {c: f"__mix_{c}" for c in ("tokens", "source", "lang", "topic")}
    col = {k: F.col(v) for k, v in own.items()}
    empty = F.lit("")
    keyed = docs.withColumn(own["tokens"], count_tokens(docs[text_col])).withColumns({own["source"]: F.coalesce(docs[source_col].cast("string"), empty), own["lang"]: F.coalesce(docs[lang_col].cast("string"), empty)}).withColumn(own["topic"], topic(docs[text_col], col["tokens"]))
    cells = materialise(keyed.groupBy(col["source"].alias("s"), col["lang"].alias("l"), col["topic"].alias("t")).agg(F.sum(col["tokens"]).cast("double").alias("n")).filter("n > 0"), "mix-cells")
    pairs = {(r.l, r.t): r.n for r in cells.groupBy("l", "t").agg(F.sum("n").alias("n")).limit(max_pairs + 1).collect()}

    def chosen(joined: DataFrame, prob: Column) -> DataFrame:
        kept = joined.filter(uniform(F.col(id_col).cast("string"), seed) < prob)
        if details:
            return kept.select(F.col(id_col).alias("doc_id"), col["source"].alias("source"), col["lang"].alias("lang"), col["topic"].alias("topic"), col["tokens"].alias("n_tokens"), F.round(prob, 6).alias("prob"))
        return kept.select(*[kept[f"`{x}`"] for x in docs.columns])

    if len(pairs) > max_pairs:
        total = cells.agg(F.sum("n")).first()[0]
        rates = _rake(cells, powers, sweeps, total, tolerance)
        scale = _cap(rates, share, total, steps)
        own_rates = rates.select(*[F.col(k).alias(f"__mix_{k}") for k in "sltr"])
        on = (col["source"] == F.col("__mix_s")) & (col["lang"] == F.col("__mix_l")) & (col["topic"] == F.col("__mix_t"))
        return chosen(keyed.join(own_rates, on, "left"), F.coalesce(F.least(F.lit(1.0), F.col("__mix_r") * F.lit(scale)), F.lit(1.0)))
    pairs = dict(sorted(pairs.items()))
    total = sum(pairs.values())

    def margin(k: int, power: float) -> dict[str, float]:
        sums: dict[str, float] = {}
        for pair, n in pairs.items():
            sums[pair[k]] = sums.get(pair[k], 0.0) + n
        scale = sum(v**power for v in sums.values())
        return {x: v**power / scale * total for x, v in sums.items()}

    by_lang, by_topic = margin(0, powers[1]), margin(1, powers[2])
    b, c = dict.fromkeys(by_lang, 1.0), dict.fromkeys(by_topic, 1.0)
    # a row for each source: its cells (at most max_pairs) and the power of its tokens
    sources = materialise(cells.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("l", "t", "n"))).alias("cells"), F.pow(F.sum("n"), F.lit(powers[0])).alias("want")), "mix-sources")
    scale = total / (sources.agg(_sum(F.col("want"))).first()[0] or 1.0)

    def factor() -> Column:
        weights = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x.n * _lookup(b, x.l) * _lookup(c, x.t))
        return F.col("want") * F.lit(scale) / weights

    fitted = None
    for _ in range(sweeps if pairs else 0):
        fitted = sources.select("s", "cells", factor().alias("a"))
        sums = dict(sorted(((r.l, r.t), r.w) for r in fitted.select("a", F.inline("cells")).groupBy("l", "t").agg(_sum(F.col("a") * F.col("n")).alias("w")).collect()))
        old = dict(b), dict(c)
        for k in by_lang:
            b[k] = by_lang[k] / sum(w * c[t] for (x, t), w in sums.items() if x == k)
        for k in by_topic:
            c[k] = by_topic[k] / sum(w * b[x] for (x, t), w in sums.items() if t == k)
        last = old
    if fitted is None:
        return chosen(keyed, F.lit(1.0))
    by = {x: sum(w * b[x] * c[t] for (y, t), w in sums.items() if y == x) / by_lang[x] for x in by_lang}
    # the source factors of the last sweep came before the others' last update
    new = (b, c)
    b, c = last
    fitted = materialise(sources.select("s", "cells", "want", factor().alias("a")), "mix-fitted")
    b, c = new
    reached = F.aggregate("cells", F.lit(0.0), lambda a, x: a + x.n * _lookup(b, x.l) * _lookup(c, x.t)) * F.col("a") / (F.col("want") * F.lit(scale))
    _off(max([abs(x - 1) for x in by.values()] + [fitted.agg(F.max(F.abs(reached - 1))).first()[0] or 0.0]), tolerance)
    rate = F.col("a") * _lookup(b, F.col("l")) * _lookup(c, F.col("t"))
    scale = _cap(materialise(fitted.select("a", F.inline("cells")).select("n", rate.alias("r")), "mix-rates"), share, total, steps)

    small = fitted.select(F.col("s").alias("__mix_s"), F.col("a").alias("__mix_a"))
    rows, size = small.agg(F.count("*"), F.sum(F.octet_length("__mix_s"))).first()
    if rows <= 100_000 and (size or 0) <= 8_000_000:
        small = F.broadcast(small)
    joined = keyed.join(small, col["source"] == F.col("__mix_s"), "left")
    prob = F.coalesce(F.least(F.lit(1.0), F.col("__mix_a") * _lookup(b, col["lang"]) * _lookup(c, col["topic"]) * F.lit(scale)), F.lit(1.0))
    return chosen(joined, prob)


def mixing_sql(share: float = 0.6, powers: tuple[float, float, float] = (0.7, 0.7, 0.9), sweeps: int = 10, steps: int = 6, seed: str = "mix", documents: str = "documents") -> str:
    """The same rows in DuckDB: the sweeps as window sums, one after another."""
    parts = [
        f"docs AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE WHEN instr(coalesce(text, ''), ' | ') > 0 THEN 'table' WHEN instr(coalesce(text, ''), '***') > 0 THEN 'marked' WHEN len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) < 40 THEN 'note' ELSE 'prose' END AS topic, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n_tokens FROM {documents})",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n, sum(n_tokens)::DOUBLE AS w FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "total AS (SELECT sum(n) AS total FROM cells)",
    ]
    for name, p in zip(("source", "lang", "topic"), powers):
        parts.append(f"want_{name} AS (SELECT {name}, pow(sum(n), {p}) / sum(pow(sum(n), {p})) OVER () * (SELECT total FROM total) AS want FROM cells GROUP BY {name})")
    at = "cells"
    for k in range(sweeps):
        for name in ("source", "lang", "topic"):
            parts.append(f"{name}{k} AS (SELECT c.source, c.lang, c.topic, n, w * want / sum(w) OVER (PARTITION BY c.{name}) AS w FROM {at} c JOIN want_{name} t ON c.{name} = t.{name})")
            at = f"{name}{k}"
    parts.append(f"rates AS MATERIALIZED (SELECT source, lang, topic, n, w / n AS r FROM {at})")
    parts.append(f"k0 AS (SELECT {share}::DOUBLE AS k)")
    for i in range(steps):
        parts.append(f"k{i + 1} AS (SELECT coalesce(({share} * (SELECT total FROM total) - coalesce(sum(n) FILTER (r * k >= 1), 0)) / nullif(sum(n * r) FILTER (r * k < 1), 0), any_value(k)) AS k FROM rates, k{i})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(least(1.0, r * k), 1.0), 6) AS prob
FROM docs d LEFT JOIN rates c ON d.source = c.source AND d.lang = c.lang AND d.topic = c.topic, k{steps}
WHERE ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / {_SCALE}.0 < coalesce(least(1.0, r * k), 1.0)"""
