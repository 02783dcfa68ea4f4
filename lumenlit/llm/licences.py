"""Licence scan by a positional rare-token index, in DataFrame functions only.

Each template is a licence's notice, or a line that names it, with a key phrase
that must stand in the text word by word. Its index entries are the two words of
its key phrase with the highest inverse document frequency over the whole input,
and where they stand in the template. Of the templates whose key words a file
holds, these two words are looked up; the places of the one, and of the other,
less their places in the template, must agree on where the template begins.
There the key phrase is verified, and the other words of the template are
counted at their relative positions. A place counts if the key phrase stands and
``coverage`` of the template's words do.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.

Cases: a null text counts as empty (no word, no label, score 0); repeated rows
and null ids come back as they are; an empty table gives no row; very long
texts are scanned whole; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str
    base: bool = False

    @property
    def parts(self) -> list[str]:
        return self.words.split()

    @property
    def key_parts(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        """Where the key phrase stands in the template."""
        n = len(self.key_parts)
        return next(i for i in range(len(self.parts)) if self.parts[i : i + n] == self.key_parts)


# Phrases and labels.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("creative-commons", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("public-domain", "released into the public domain", "public domain"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "obtaining a copy of this software and associated documentation files"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "may not use this file except in compliance with the license"),
    Template("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "free software foundation either version 3 of the license"),
    Template("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "free software foundation either version 2 of the license"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl was not distributed with this file"),
    Template("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, before lower-casing.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaced_words(text: Column) -> Column:
    """The words of a text with one space between them; case as it is."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BETWEEN, " "))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows, and in how many of them each word of the (fixed, short) vocabulary
    stands; counted over all rows."""
    some = words.select(F.explode(F.concat(F.array_intersect("words", _strings(vocabulary)), F.array(F.lit("")))).alias("w"))
    found = {r.w: r.n for r in some.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return found.pop("", 0), found


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, coverage: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, and ``places``: the template label
    and first word of every accepted place."""
    vocabulary = sorted({w for t in templates for w in t.key_parts})
    text = spaced_words(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("spaced"))
    cut = F.split(F.translate("spaced", _UPPER, _LOWER), " ")
    n, df = document_frequencies(rows.select(cut.alias("words")), vocabulary)

    postings, anchors, looked = [], set(), set()
    for i, t in enumerate(templates):
        # by inverse document frequency: the rarest two words of the key phrase
        rare = sorted(set(t.key_parts), key=lambda w: (df.get(w, 0), w))
        first, second = rare[0], rare[min(1, len(rare) - 1)]
        anchors.add(first)
        looked |= {first, second}
        at = [F.lit(t.key_at + t.key_parts.index(w)) for w in (first, second)]
        postings.append(F.struct(F.lit(i).alias("t"), F.lit(first).alias("w1"), at[0].alias("o1"), F.lit(second).alias("w2"), at[1].alias("o2"), F.lit(t.key_at).alias("key_at"), _strings(t.key_parts).alias("key"), _strings(t.parts).alias("parts")))

    def places_of(words: Column, present: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h.w.isin(sorted(looked)))

        def place(start: Column, p: Column) -> Column:
            key_at = start + p.key_at
            stands = F.slice(words, key_at + 1, F.size(p.key)) == p.key
            hit = F.filter(p.parts, lambda w, j: F.try_element_at(words, F.when(start + j >= 0, start + j + 1).otherwise(F.size(words) + 1)) == w)
            return F.struct(p.t.alias("t"), key_at.alias("first"), F.when(stands, F.size(hit) / F.size(p.parts)).alias("cover"))

        def starts(p: Column, word: str, at: str) -> Column:
            return F.filter(F.transform(F.filter(hits, lambda h: h.w == p[word]), lambda h: h.i - p[at]), lambda x: x + p.key_at >= 0)

        possible = F.filter(F.array(*postings), lambda p: F.size(F.array_except(p.key, present)) == 0)
        by_template = F.transform(possible, lambda p: F.transform(F.array_intersect(starts(p, "w1", "o1"), starts(p, "w2", "o2")), lambda s: place(s, p)))
        return F.filter(F.flatten(by_template), lambda x: x.cover >= coverage)

    present = F.array_intersect(F.col("words"), _strings(vocabulary))
    nothing = F.array().cast("array<struct<t:int,first:int,cover:double>>")
    # a text without any anchor is neither lower-cased nor cut
    first_rare = F.col("spaced").rlike("(?i)" + "|".join(rf"\b{a}\b" for a in sorted(anchors)))
    worked = rows.withColumn("words", F.when(first_rare, cut)).withColumn("present", present).withColumn("found", F.when(F.col("words").isNotNull(), places_of(F.col("words"), F.col("present")).cast("array<struct<t:int,first:int,cover:double>>")).otherwise(nothing))
    base = [i for i, t in enumerate(templates) if t.base]
    label = _strings(t.label for t in templates)

    def labels_of(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.element_at(label, x.t + 1)))), ",")

    based = worked.withColumn("based", F.filter("found", lambda x: x.t.isin(base)))
    n_words = F.when(F.col("spaced") == "", 0).otherwise(F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))) + 1)
    return based.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        F.size("based").cast("long").alias("n_base"),
        F.array_min(F.transform("based", lambda x: x.first)).cast("long").alias("first_word"),
        F.array_max(F.transform("based", lambda x: x.first)).cast("long").alias("last_word"),
        labels_of(F.col("based")).alias("base_labels"),
        labels_of(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.cover)), F.lit(0.0)).alias("score"),
        F.transform("found", lambda x: F.struct(F.element_at(label, x.t + 1).alias("label"), x.first.alias("first"), x.cover.alias("cover"))).alias("places"),
    )


def licence_sql(templates: tuple[Template, ...] = TEMPLATES, coverage: float = 0.5) -> str:
    """The same result in DuckDB, by trying every place."""
    found = []
    for t in templates:
        k, at = t.key_parts, t.key_at
        stands = " AND ".join(f"w[i+{j + 1}] = '{x}'" for j, x in enumerate(k))
        cover = "(" + " + ".join(f"CASE WHEN i+{j - at} >= 0 AND w[i+{j - at + 1}] = '{x}' THEN 1 ELSE 0 END" for j, x in enumerate(t.parts)) + f") / {len(t.parts)}.0::DOUBLE"
        found.append(f"list_filter(list_transform(list_filter(range(0, len(w)), lambda i: {stands}), lambda i: {{'label': '{t.label}', 'base': {str(t.base).lower()}, 'first': i, 'cover': {cover}}}), lambda x: x.cover >= {coverage})")
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, len(w) AS n, flatten([{", ".join(found)}]) AS f FROM words),
based AS (SELECT *, list_filter(f, lambda x: x.base) AS b FROM found)
SELECT doc_id, n::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(list_transform(b, lambda x: x.first))::BIGINT AS first_word, list_max(list_transform(b, lambda x: x.first))::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(b, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(f, lambda x: x.label))), ',') AS labels,
  coalesce(list_max(list_transform(f, lambda x: x.cover)), 0.0)::DOUBLE AS score
FROM based"""
