"""Licence notices in texts, by Dice's coefficient over word bigrams, with DataFrame functions only.

A text is cut into passages: its paragraphs (between blank lines), lines and sentences. A passage is normalised
(A-Z lower-cased, all but a-z and 0-9 becomes a space) and its set of word bigrams is compared with
each template's: ``2 * both / (passage + template)``. Windows over two or more consecutive pieces (the text cut at
newlines and sentence ends; comment marks are no words) are compared too, for notices that are wrapped. They have at
most ``(2 - t) / t`` times the words of the longest template that the text holds an anchor of. Of overlapping windows the closest counts, and a window is left out
where a passage in it or around it is as close. A template is a candidate only if its size is within
the bounds that the threshold allows: a passage of n bigrams can reach t only with templates of
``t / (2 - t) * n`` to ``(2 - t) / t * n`` bigrams.

A passage that reaches t shares at least ``t / (2 - t)`` of a template's bigrams, so it holds at least one of
any larger rest of them (see ``Template.anchors``). Texts without an anchor aren't cut at all; this loses
nothing.

All work is within a row; nothing is shuffled. Nulls: a null or empty text has no passages and no hits.
Repeated rows and ids are judged row by row. Templates that tie are all hits, but of those that are alike the closest
only, or all that tie as closest. A text of any length is looked at whole. A column license_hits of df is replaced,
columns of any other name stay. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.common import fresh

# Wordings of notices, by name.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:"
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}


def _gnu(what: str, name: str, version: str) -> str:
    return (
        f"{what}; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        f"Software Foundation; either version {version} of the License, or (at your option) any later version."
    )


# Further notices, which the SQL below doesn't have.
NOTICES: dict[str, str] = {
    "GPL-3.0-or-later": _gnu("This program is free software", "General Public License", "3"),
    "LGPL-2.1-or-later": _gnu("This library is free software", "Lesser General Public License", "2.1"),
    "LGPL-3.0-or-later": _gnu("This library is free software", "Lesser General Public License", "3"),
    "AGPL-3.0-or-later": _gnu("This program is free software", "Affero General Public License", "3"),
}

# Notices that differ in a name or a version only; of these the closest to a passage counts.
ALIKE = {"GPL-2.0-or-later", *NOTICES}


def normalised(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


@dataclass(frozen=True)
class Template:
    name: str
    bigrams: tuple[str, ...]

    @staticmethod
    def of(name: str, text: str) -> Template:
        words = normalised(text)
        if len(words) < 2:
            raise ValueError(f"the template {name} has no bigram")
        return Template(name, tuple(sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})))

    def anchors(self, threshold: float, common: dict[str, int]) -> list[str]:
        """Bigrams one of which a passage must share to reach the threshold.

        With T bigrams here and both shared, the passage has at least both, so Dice is at most
        2 * both / (both + T) and both >= t * T / (2 - t). Any T - that + 1 bigrams hold a shared one. Those that
        the fewest templates have are taken.
        """
        least = math.ceil(threshold * len(self.bigrams) / (2 - threshold) - 1e-9)
        return sorted(self.bigrams, key=lambda b: (common[b], -len(b), b))[: len(self.bigrams) - least + 1]


def _cover(anchors: list[str], least: int = 5) -> list[str]:
    """Words of at least so many letters such that each anchor holds one of them; an anchor without such a word stands for itself."""
    left, chosen = list(anchors), []
    while left:
        counts: dict[str, int] = {}
        for a in left:
            for w in [w for w in a.split() if len(w) >= least] or [a]:
                counts[w] = counts.get(w, 0) + 1
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        chosen.append(best)
        left = [a for a in left if best not in a.split() and best != a]
    return chosen


def _clean(text: Column) -> Column:
    # What is left has no other letters than A-Z and a-z.
    return F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))


def _marked(text: Column) -> Column:
    return F.regexp_replace(text, "([.!?])[ \t]+", "$1\n")


def _pieces(text: Column) -> Column:
    """What lies between newlines and sentence ends, normalised, of at least one word."""
    return F.filter(F.transform(F.split(_marked(text), "\n"), _clean), lambda p: p != "")


def passages(text: Column) -> Column:
    """Distinct paragraphs, lines and sentences, normalised, of at least two words."""
    marked = _marked(text)
    cut = F.concat(F.split(text, "\n[ \t\r]*\n"), F.split(text, "\n"), F.split(marked, "\n"))
    return F.array_distinct(F.filter(F.transform(cut, _clean), lambda p: F.contains(p, F.lit(" "))))


def word_bigrams(clean: Column) -> Column:
    words = F.split(clean, " ")
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.array_distinct(pairs)


def scan_licenses(
    df: DataFrame, text_col: str = "text", *, templates: dict[str, str] = TEMPLATES | NOTICES, threshold: float = 0.8
) -> DataFrame:
    """df with license_hits: array of (license, permille int, passage string) for each passage or window and each template
    whose Dice coefficient reaches the threshold, sorted. permille is 1000 times the coefficient, rounded down."""
    made = [Template.of(n, t) for n, t in templates.items()]
    common: dict[str, int] = {}
    for t in made:
        for b in t.bigrams:
            common[b] = common.get(b, 0) + 1
    anchors = sorted({a for t in made for a in t.anchors(threshold, common)})
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    clean = _clean(text)
    whole = F.col(fresh(df, "license_text"))

    def anchored(words: Column, some: list[str] = anchors) -> Column:
        found = F.lit(False)
        for a in some:
            found = found | F.contains(words, F.lit(a))
        return found

    # Words of which each anchor has one are fewer than anchors.
    possible = anchored(whole, _cover(anchors)) & anchored(whole)
    table = F.array(
        *[F.struct(F.lit(t.name).alias("name"), F.lit("alike" if t.name in ALIKE else t.name).alias("kind"), F.array(*map(F.lit, t.bigrams)).alias("bigrams"), F.lit(len(t.bigrams)).cast("long").alias("n")) for t in made]
    )
    # The threshold as a fraction of integers, so that a coefficient equal to it counts.
    per = round(threshold * 1_000_000)

    def of_passage(p: Column) -> Column:
        def scored(b: Column) -> Column:
            fits = F.filter(
                table, lambda t: (t["n"] * (2_000_000 - per) >= F.size(b).cast("long") * per) & (F.size(b).cast("long") * (2_000_000 - per) >= t["n"] * per)
            )
            both = F.transform(
                fits,
                lambda t: F.struct(
                    t["name"].alias("license"),
                    t["kind"].alias("kind"),
                    F.size(F.array_intersect(b, t["bigrams"])).cast("long").alias("both"),
                    (F.size(b) + t["n"]).alias("sizes"),
                ),
            )
            hit = F.filter(both, lambda x: x["both"] * 2_000_000 >= x["sizes"] * per)
            closest = F.transform(
                F.array(hit),
                lambda all_: F.filter(all_, lambda x: ~F.exists(all_, lambda y: (y["kind"] == x["kind"]) & (y["both"] * x["sizes"] > x["both"] * y["sizes"]))),
            )
            return F.transform(
                F.flatten(closest),
                lambda x: F.struct(
                    x["license"].alias("license"), F.floor(x["both"] * 2000 / x["sizes"]).cast("int").alias("permille"), p.alias("passage"), x["kind"].alias("kind")
                ),
            )

        return F.flatten(F.transform(F.array(word_bigrams(p)), scored))

    def most_words(present: Column) -> Column:
        """The words that a window may have: of the longest template that the text holds an anchor of."""
        return F.array_max(F.array(*[
            F.when(F.arrays_overlap(present, F.array(*map(F.lit, t.anchors(threshold, common)))), math.floor(len(normalised(templates[t.name])) * (2_000_000 - per) / per + 1e-9)).otherwise(0)
            for t in made
        ]))

    def of_windows(x: Column) -> Column:
        """(less int, words int, start int, end int, hit) for each window that reaches the threshold, from pieces(text, words),
        the anchors that are present, and the most words."""
        pieces, most = x["pieces"], x["most"]

        def joined(run: Column) -> Column:
            return F.array_join(F.transform(run, lambda p: p["text"]), " ")

        def from_start(i: Column) -> Column:
            def of_run(run: Column) -> Column:
                def longer(acc: Column, p: Column) -> Column:
                    n = acc["words"] + p["words"]
                    return F.struct(n.alias("words"), (acc["fit"] + (n <= most).cast("int")).alias("fit"))

                fit = F.aggregate(run, F.struct(F.lit(0).alias("words"), F.lit(0).alias("fit")), longer, lambda acc: acc["fit"])
                start = F.transform(F.array(F.call_function("substring_index", joined(run), F.lit(" "), most)), lambda w: F.exists(x["present"], lambda a: F.contains(w, a)))
                near = F.element_at(start, 1)
                ends = F.when(near, F.filter(F.transform(F.array(fit), lambda n: F.when(n >= 2, F.sequence(F.lit(2), n))), lambda e: e.isNotNull()))
                return F.flatten(F.transform(F.flatten(F.coalesce(ends, F.array().cast("array<array<int>>"))), lambda k: of_window(run, k)))

            def of_window(run: Column, k: Column) -> Column:
                hits = F.flatten(F.transform(F.array(joined(F.slice(run, F.lit(1), k))), of_passage))
                return F.transform(
                    hits,
                    lambda h: F.struct(
                        (-h["permille"]).alias("less"), F.size(F.split(h["passage"], " ")).alias("words"), i.alias("start"), (i + k - 1).alias("end"), h.alias("hit")
                    ),
                )

            return F.flatten(F.transform(F.array(F.slice(pieces, i, most)), of_run))

        starts = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1))
        return F.flatten(F.transform(starts, from_start))

    kind = "struct<license:string,permille:int,passage:string,kind:string>"
    no_windows = F.array().cast(f"array<struct<less:int,words:int,start:int,end:int,hit:{kind}>>")

    def apart(taken: Column, w: Column) -> Column:
        # Alike notices that tie in one window are all taken.
        clash = F.exists(
            taken,
            lambda x: (x["hit"]["kind"] == w["hit"]["kind"]) & (x["start"] <= w["end"]) & (w["start"] <= x["end"]) & (x["hit"]["passage"] != w["hit"]["passage"]),
        )
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(w)))

    def within(a: Column, b: Column) -> Column:
        return F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))

    def with_windows(plain: Column) -> Column:
        present = F.array(F.filter(F.array(*map(F.lit, anchors)), lambda a: F.contains(whole, a)))
        pieces = F.transform(_pieces(text), lambda p: F.struct(p.alias("text"), F.size(F.split(p, " ")).alias("words")))
        bound = F.transform(present, lambda a: F.struct(pieces.alias("pieces"), a.alias("present"), most_words(a).alias("most")))
        windows = F.coalesce(F.flatten(F.transform(bound, of_windows)), no_windows)
        wide = F.transform(F.aggregate(F.array_sort(windows), no_windows, apart), lambda w: w["hit"])
        new = F.filter(
            wide,
            lambda h: ~F.exists(
                plain,
                lambda p: (p["kind"] == h["kind"]) & (p["permille"] >= h["permille"]) & (within(p["passage"], h["passage"]) | within(h["passage"], p["passage"])),
            ),
        )
        return F.array_distinct(F.concat(plain, new))

    found = F.flatten(F.transform(F.array(F.flatten(F.transform(passages(text), of_passage))), with_windows))
    bare = F.transform(found, lambda h: F.struct(h["license"].alias("license"), h["permille"].alias("permille"), h["passage"].alias("passage")))
    none = F.array().cast("array<struct<license:string,permille:int,passage:string>>")
    hits = F.when(possible, F.sort_array(bare)).otherwise(none)
    name = fresh(df, "license_text")
    kept = [F.col(f"`{c}`") for c in df.columns if c != "license_hits"]
    return df.withColumn(name, clean).select(*kept, hits.alias("license_hits"))


def oracle(table: str, threshold_millionths: int = 800_000) -> str:
    """The same over a table with doc_id and text, in DuckDB's SQL, without the pruning, the windows and NOTICES: equal where
    no notice is wrapped or one of NOTICES. See queries.py."""
    rows = ", ".join("('" + n + "', [" + ", ".join("'" + b + "'" for b in Template.of(n, t).bigrams) + "])" for n, t in TEMPLATES.items())
    return f"""
WITH templates(license, tb) AS (VALUES {rows}),
cut AS (
  SELECT doc_id, unnest(list_concat(
    regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n'), string_split(coalesce(text, ''), chr(10)),
    string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)))) AS passage FROM {table}),
clean AS (
  SELECT DISTINCT doc_id, trim(lower(regexp_replace(passage, '[^A-Za-z0-9]+', ' ', 'g'))) AS passage FROM cut),
words AS (SELECT doc_id, passage, string_split(passage, ' ') AS w FROM clean WHERE contains(passage, ' ')),
sets AS (
  SELECT doc_id, passage, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS b FROM words),
scored AS (
  SELECT doc_id, passage, license, len(list_intersect(b, tb)) AS n, len(b) + len(tb) AS sizes FROM sets, templates
  WHERE len(tb) * (2000000 - {threshold_millionths}) >= len(b) * {threshold_millionths}
    AND len(b) * (2000000 - {threshold_millionths}) >= len(tb) * {threshold_millionths}),
hits AS (SELECT *, (n * 2000) // sizes AS permille FROM scored WHERE n * 2000000 >= sizes * {threshold_millionths}),
per_doc AS (
  SELECT doc_id, count(*) AS n_hits, max(permille) AS best_permille,
    array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_hits, 0)::BIGINT AS n_hits, best_permille::BIGINT AS best_permille, coalesce(licenses, '') AS licenses
FROM {table} d LEFT JOIN per_doc p ON d.doc_id = p.doc_id"""
