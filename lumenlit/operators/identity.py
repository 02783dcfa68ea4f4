"""Which rows are one paper: official ids and feed links merge, titles only
propose, what contradicts itself stays apart and is recorded."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlit.operators.graph import connected
from lumenlit.operators.shared import checkpointed

# Forum ids that a listing makes up, and prefixes of sources whose record ids count.
_MADE_UP = r"(?i)^\d{4}-(?:oral|spotlight|poster)--"
_SOURCES = r"^(anthology|pmlr|aaai):"


def forum_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]+)", 1), F.lit(""))


def official_id(url: Column, source: Column, record: Column) -> Column:
    """(kind, value) of the row's own identifier, or null."""
    forum = forum_id(url)
    kind = F.regexp_extract(source, _SOURCES, 1)
    return (
        F.when(forum.isNotNull() & ~forum.rlike(_MADE_UP), F.struct(F.lit("openreview").alias("kind"), forum.alias("value")))
        .when(kind != "", F.struct(kind.alias("kind"), F.concat(source, F.lit("#"), record.cast("string")).alias("value")))
        .when(url.startswith("http") & ~url.contains("openreview.net"), F.struct(F.lit("url").alias("kind"), url.alias("value")))
    )


def track_of(source: Column) -> Column:
    """The track a row was listed in; null where it isn't known."""
    s = F.trim(F.coalesce(source, F.lit("")))
    return F.when(~s.isin("", "None"), F.regexp_replace(s, "^cdmx-|-cdmx$", ""))


def feed_keys(sourceid: Column, uid: Column) -> Column:
    """(sid, uid): the number without its sign and the feed's key; null where
    the row has none."""
    number = sourceid.try_cast("bigint")
    return F.struct(F.when(number != 0, F.abs(number).cast("string")).alias("sid"), F.nullif(uid.cast("string"), F.lit("")).alias("uid"))


def person(name: Column) -> Column:
    """A name in plain lower-case letters."""
    plain = F.translate(F.lower(name), "áàâäãåçéèêëíìîïñóòôöõúùûüýÿšžčćřěůłø", "aaaaaaceeeeiiiinooooouuuuyyszccreulo")
    return F.trim(F.regexp_replace(plain, "[^a-z ]", ""))


def _disjoint(named) -> bool:
    """Whether two of these sets of names share nothing."""
    some = list(named)
    if not some or frozenset.intersection(*some):
        return False
    return any(a.isdisjoint(b) for k, a in enumerate(some) for b in some[:k])


class _Group:
    """Rows that are one paper so far: their places, distinct author lists, and
    for each kind of id the first place and the value. No two of its lists are
    disjoint and no kind has two values."""

    def __init__(self, place: int, row: dict):
        self.rows = [place]
        self.names = {row["names"]} if row["names"] else set()
        self.ids = {row["kind"]: (place, row["value"])} if row["kind"] is not None else {}

    def against(self, other: _Group) -> str | None:
        """Why both can't be one paper."""
        if any(a.isdisjoint(b) for a in self.names for b in other.names):
            return "disjoint author lists"
        apart = [(min(at, other.ids[kind][0]), kind) for kind, (at, value) in self.ids.items() if kind in other.ids and other.ids[kind][1] != value]
        return f"different {min(apart)[1]} ids" if apart else None

    def take(self, other: _Group) -> None:
        self.rows += other.rows
        self.names |= other.names
        for kind, own in other.ids.items():
            self.ids[kind] = min(own, self.ids.get(kind, own))


class _Block:
    """Rows that shared keys tie together, in their fixed order."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda r: (r["eventtype"], r["event"] is None, r["event"] or ""))
        for r in self.rows:
            r["names"] = frozenset(r["names"])
        self.groups = [_Group(i, r) for i, r in enumerate(self.rows)]  # each row's group
        self.rules = [set() for _ in self.rows]
        self.notes: list[set[str]] = [set() for _ in self.rows]

    def against(self, rows: list[int]) -> str | None:
        """Why these rows can't be one paper."""
        if _disjoint({self.rows[i]["names"] for i in rows if self.rows[i]["names"]}):
            return "disjoint author lists"
        ids = defaultdict(set)
        for i in rows:
            if self.rows[i]["kind"] is not None:
                ids[self.rows[i]["kind"]].add(self.rows[i]["value"])
        return next((f"different {kind} ids" for kind, values in ids.items() if len(values) > 1), None)

    def note(self, rows: list[int], reason: str) -> None:
        for i in rows:
            self.notes[i].add(reason)

    def tie(self, rows: list[int], rule: str) -> None:
        if len(rows) < 2:
            return
        if reason := self.against(rows):
            self.note(rows, reason)
            return
        for i in rows[1:]:
            a, b = self.groups[rows[0]], self.groups[i]
            if a is not b:
                if reason := a.against(b):
                    self.note(a.rows + b.rows, f"{reason} (through an earlier merge)")
                    continue
                if len(a.rows) < len(b.rows):
                    a, b = b, a
                a.take(b)
                for k in b.rows:
                    self.groups[k] = a
        for i in rows:
            self.rules[i].add(rule)

    def by(self, *names: str) -> dict[tuple, list[int]]:
        out = defaultdict(list)
        for i, r in enumerate(self.rows):
            if all(r[n] is not None for n in names):
                out[tuple(r[n] for n in names)].append(i)
        return out

    def settle(self) -> None:
        for (kind, _), rows in self.by("kind", "value").items():
            self.tie(rows, kind)
        for _, rows in self.by("sid", "has_feed").items():
            tracks = defaultdict(list)
            for i in rows:
                tracks[self.rows[i]["track"]].append(i)
            unknown = tracks.pop(None, [])
            if len(tracks) <= 1:  # a row without a track joins the only one there is
                tracks = {None: sorted(unknown + [i for own in tracks.values() for i in own])}
            for own in tracks.values():
                if len({self.rows[i]["uid"] for i in own}) > 1:
                    self.note(own, "feed keys disagree: one |sourceid|, several uids")
                else:
                    self.tie(own, "feed")
        for _, rows in self.by("track_text", "uid", "has_feed").items():
            if len({self.rows[i]["sid"] for i in rows}) > 1:
                self.note(rows, "feed keys disagree: one uid, several |sourceid|")


def _settled_batch(rows: list[tuple]) -> pa.RecordBatch:
    of = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), of)], names=["event", "paper", "rules", "conflicts", "missing_key"])


def identify(rows: DataFrame) -> DataFrame:
    """Rows (event, eventtype, title, authors, url, sourceid, uid, source,
    record) to: event, paper (the event of the group's first row, by event type
    and id as texts), rules that merged it, conflicts, and missing_key.

    Rows that share an official id or a feed key are gathered by connected
    components; only these few meet in a task, which then checks whole groups,
    in a fixed order whatever the order of the input. Null authors are no
    authors; rows without any key are papers of their own.
    """
    keyed = rows.select(
        F.col("event").cast("string").alias("event"),
        F.coalesce("eventtype", F.lit("")).alias("eventtype"),
        F.array_distinct(F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), person), lambda x: x != "")).alias("names"),
        official_id(F.col("url"), F.col("source"), F.col("record")).alias("o"),
        feed_keys(F.col("sourceid"), F.col("uid")).alias("f"),
        track_of(F.col("source")).alias("track"),
    )
    whole = F.col("f.sid").isNotNull() & F.col("f.uid").isNotNull()
    flat = keyed.select("event", "eventtype", "names", F.col("o.kind").alias("kind"), F.col("o.value").alias("value"), F.when(whole, F.col("f.sid")).alias("sid"), F.when(whole, F.col("f.uid")).alias("uid"), F.when(whole, F.lit(1)).alias("has_feed"), "track", F.coalesce("track", F.lit("")).alias("track_text"), F.when(~whole & F.col("f.uid").isNull() & F.col("f.sid").isNotNull(), "uid").when(~whole & F.col("f.sid").isNull() & F.col("f.uid").isNotNull(), "sourceid").alias("missing_key"))
    flat = checkpointed(flat.withColumn("node", F.monotonically_increasing_id()))
    keys = [F.when(F.col("kind").isNotNull(), F.concat_ws("\u0001", F.lit("o"), "kind", "value")), F.when(F.col("sid").isNotNull(), F.concat_ws("\u0001", F.lit("s"), "sid")), F.when(F.col("uid").isNotNull(), F.concat_ws("\u0001", F.lit("u"), "track_text", "uid"))]
    tied = flat.select("node", F.explode(F.array_compact(F.array(*keys))).alias("k"))
    head = tied.groupBy("k").agg(F.min("node").alias("b"))
    edges = tied.join(head, "k").filter("node != b").select(F.col("node").alias("a"), "b").distinct()
    block = connected(edges).withColumnRenamed("component", "block")
    alone = flat.join(block, "node", "left_anti").select("event", F.col("event").alias("paper"), F.array().cast("array<string>").alias("rules"), F.array().cast("array<string>").alias("conflicts"), "missing_key")

    names = ["event", "eventtype", "names", "kind", "value", "sid", "uid", "has_feed", "track", "track_text", "missing_key"]

    def settled(rows: list[dict]) -> list[tuple]:
        own = _Block(rows)
        own.settle()
        heads, rules = {}, {}
        for g in own.groups:
            if id(g) not in heads:
                heads[id(g)] = own.rows[min(g.rows)]["event"]
                rules[id(g)] = sorted(set().union(*(own.rules[i] for i in g.rows))) if len(g.rows) > 1 else []
        return [(r["event"], heads[id(g)], rules[id(g)], sorted(notes), r["missing_key"]) for r, g, notes in zip(own.rows, own.groups, own.notes)]

    def run(stream):
        """Blocks follow one another, sorted: a batch of them at a time, for
        most hold two rows."""
        at, held = None, []
        for batch in stream:
            done = []
            for block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if block != at and held:
                    done += settled(held)
                    held = []
                at = block
                held.append(dict(zip(names, row)))
            if done:
                yield _settled_batch(done)
        if held:
            yield _settled_batch(settled(held))

    rows = flat.join(block, "node").select("block", *names).repartition("block").sortWithinPartitions("block")
    grouped = rows.mapInArrow(run, "event string, paper string, rules array<string>, conflicts array<string>, missing_key string")
    return grouped.union(alone)


def same_titles(papers: DataFrame) -> DataFrame:
    """Rows (event, paper, title) to (paper, other): papers that share a title
    and were not merged. Candidates, each against the first of its title."""
    key = F.regexp_replace(F.lower("title"), r"\W+", "")
    by = papers.select("paper", key.alias("k")).filter("k != ''").distinct()
    first = by.groupBy("k").agg(F.min("paper").alias("other"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return by.join(first, "k").filter("paper != other").select("paper", "other").distinct()


# --- catalogue ------------------------------------------------------------------------------------------------------


def merge_entities(entities: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, name_key, kind, registered, aliases, developers) that a
    paper of one claim (id, claim, paper, edition, year) introduces under one
    name and kind are one. Returns the merged entities (id, merged_ids,
    aliases, developers, claims, first_edition) and the map (old, id)."""
    named = claims.join(entities.select("id", "name_key", "kind"), "id")
    same = named.groupBy("name_key", "kind", "paper").agg(F.min("id").alias("b"))
    edges = named.join(same, ["name_key", "kind", "paper"]).filter("id != b").select(F.col("id").alias("a"), "b").distinct()
    groups = connected(edges)
    owned = entities.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("g", F.coalesce("component", "id")).drop("component")
    rank = F.struct(~F.coalesce("registered", F.lit(False)), F.length(F.col("id").cast("string")), "id")
    heads = owned.groupBy("g").agg(F.min_by("id", rank).alias("head"))
    remap = owned.join(heads, "g").select(F.col("id").alias("old"), F.col("head").alias("id"), "aliases", "developers")
    lists = remap.groupBy("id").agg(
        F.array_sort(F.collect_set(F.when(F.col("old") != F.col("id"), F.col("old")))).alias("merged_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("developers")))).alias("developers"),
    )
    own = claims.withColumnRenamed("id", "old").join(remap.select("old", "id"), "old").dropDuplicates(["id", "claim"])
    ordered = own.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("year", "edition", "paper", "claim"))).alias("c"))
    out = lists.join(ordered, "id", "left").select("id", "merged_ids", "aliases", "developers", F.transform("c", lambda x: x.claim).alias("claims"), F.col("c")[0]["edition"].alias("first_edition"))
    return out, remap.select("old", "id")
