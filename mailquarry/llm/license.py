"""Licence notices by the Dice coefficient of word bigrams, in DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"

# Customary wordings of notices, and short licence texts, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0-only": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(words: list[str]) -> list[str]:
    """Distinct pairs of neighbouring words, in order; a single word stands for itself."""
    return list(dict.fromkeys([f"{a} {b}" for a, b in zip(words, words[1:])] or words))


def size_bounds(n: int, least: float = LEAST) -> tuple[int, int]:
    """Sizes of a bigram set whose Dice coefficient with a set of n can reach `least`."""
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def telling_words(bigrams: list[str], least: float = LEAST) -> set[str]:
    """Words of which any text that reaches `least` has one.

    It shares at least least / (2 - least) of the template's bigrams, so of any more than the rest it has one. Those with
    the longest words are taken, each by its longest word.
    """
    spare = len(bigrams) - math.ceil(len(bigrams) * least / (2 - least) - 1e-9) + 1
    longest = lambda b: max(b.split(), key=lambda w: (len(w), w))
    return {longest(b) for b in sorted(bigrams, key=lambda b: (-len(longest(b)), b))[:spare]}


def template_rows(templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> list[tuple[int, str, int, list[str]]]:
    """(size of a unit, licence, number of the wording, bigrams): each wording under every size that its bounds admit."""
    rows = []
    for name, wordings in templates.items():
        for i, wording in enumerate(wordings):
            grams = bigrams_of(words_of(wording))
            low, high = size_bounds(len(grams), least)
            rows += [(n, name, i, grams) for n in range(max(low, 1), high + 1)]
    return rows


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def anchors(templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> dict[str, list[tuple[str, int, int, int]]]:
    """Telling words with (licence, wording, place in the wording from 0, words of it): where a wording may begin."""
    out: dict[str, list[tuple[str, int, int, int]]] = {}
    for name, wordings in templates.items():
        for i, wording in enumerate(wordings):
            words = words_of(wording)
            for w in sorted(telling_words(bigrams_of(words), least)):
                out.setdefault(w, []).append((name, i, words.index(w), len(words)))
    return out


def _windows(words: Column, templates: dict[str, list[str]], least: float) -> Column:
    """(licence, wording, words) of the windows as long as a wording, laid so that one of its telling words stands at its
    place; each start once."""
    of_word = anchors(templates, least)
    where = F.create_map(*[x for w, ts in of_word.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(i).alias("wording"), F.lit(at).alias("at"), F.lit(size).alias("n")) for n, i, at, size in ts]))])
    told = F.filter(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p"))), lambda x: x["w"].isin(list(of_word)))
    laid = F.transform(told, lambda x: F.transform(where[x["w"]], lambda t: F.struct(t["licence"].alias("licence"), t["wording"].alias("wording"), (x["p"] - t["at"]).alias("start"), t["n"].alias("n"))))

    def window(t: Column) -> Column:
        first = F.greatest(t["start"], F.lit(0))
        return F.struct(t["licence"].alias("licence"), t["wording"].alias("wording"), F.slice(words, first + 1, F.greatest(t["start"] + t["n"] - first, F.lit(0))).alias("words"))

    return F.transform(F.array_distinct(F.flatten(laid)), window)


def notices(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, unit, place, licence, wording, dice): licence wordings in docs, wherever they stand.

    Units are the lines of a text; its paragraphs (between blank lines) where they have more than one line; and windows of
    a paragraph as long as a wording, laid at its telling words, so that a notice is found inside a line, over several
    lines and with words put in, left out or changed. place: number of the line or paragraph, from 0. Units are
    lower-cased and cut into runs of letters and digits. Dice is taken over the sets of word bigrams. Texts without any
    telling word are passed over, which loses nothing (see telling_words). Templates are a fixed table, filed under each
    size that a unit may have, so a unit meets only those in its size bounds, by an equi-join with that small table. All
    at or above `least` are listed, ties included. A line "SPDX-License-Identifier: x" names x itself: unit `spdx`, place
    its number, wording -1, dice 1. Null and empty texts have no rows; repeated documents repeat theirs; a long text is
    split in place and never gathered. Other columns are not read.
    """
    spark = docs.sparkSession
    filed = spark.createDataFrame(template_rows(templates, least), "size int, licence string, wording int, grams array<string>")
    telling = sorted(set().union(*(telling_words(bigrams_of(words_of(w)), least) for ws in templates.values() for w in ws)))
    some = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(map(re.escape, telling))})(?![\p{{L}}\p{{N}}])"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.select("doc_id", F.lower("text").alias("text")).where(F.col("text").rlike(some))
    cut_at = lambda unit, ends: F.transform(F.split("text", ends), lambda body, i: F.struct(F.lit(unit).alias("unit"), i.alias("place"), body.alias("body")))
    units = texts.select("doc_id", F.explode(F.concat(cut_at("line", "\n"), cut_at("paragraph", r"\n[ \t\r]*\n"))).alias("u")).select("doc_id", "u.*").where(F.col("body").rlike(some))
    split = units.withColumn("words", F.regexp_extract_all("body", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    none = F.array().cast("array<struct<licence:string,wording:int,words:array<string>>>")
    whole = F.when((F.col("unit") == "line") | F.col("body").contains("\n"), F.array(F.struct(F.lit(None).cast("string").alias("licence"), F.lit(None).cast("int").alias("wording"), F.col("words").alias("words")))).otherwise(none)
    every = split.select("doc_id", "unit", "place", F.explode(F.concat(whole, F.when(F.col("unit") == "paragraph", _windows(F.col("words"), templates, least)).otherwise(none))).alias("c"))
    grams = every.withColumn("own", _bigrams(F.col("c.words"))).select("doc_id", "unit", "place", "own", F.size("own").alias("size"), F.col("c.licence").alias("for_licence"), F.col("c.wording").alias("for_wording"))
    met = grams.join(F.broadcast(filed), "size").where("for_licence is null or for_licence = licence and for_wording = wording")
    dice = F.round(2 * F.size(F.array_intersect("own", "grams")) / (F.col("size") + F.size("grams")), 6)
    unit = F.when(F.col("for_licence").isNotNull(), "window").otherwise(F.col("unit")).alias("unit")
    found = met.withColumn("dice", dice).where(F.col("dice") >= least).select("doc_id", unit, "place", "licence", "wording", "dice")
    named = rows.where(F.col("text").contains("SPDX-License-Identifier:")).select("doc_id", F.lit("spdx").alias("unit"), F.posexplode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("place", "licence"), F.lit(-1).alias("wording"), F.lit(1.0).alias("dice"))
    return found.unionByName(named)


def oracle_sql(templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, {i}, {quoted(w)})" for n, ws in templates.items() for i, w in enumerate(ws))
    laid = ", ".join(f"({quoted(w)}, {quoted(n)}, {i}, {at}, {size})" for w, ts in anchors(templates, least).items() for n, i, at, size in ts)
    grams = "list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end)"
    return rf"""
with t as (select licence, wording, {grams} as g from (select licence, wording, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') as w from (values {values}) v(licence, wording, body))),
a as (select * from (values {laid}) v(word, licence, wording, stands, n)),
lines as (select doc_id, 'line' as unit, unnest(range(len(l))) as place, unnest(l) as body from (select doc_id, string_split(lower(text), chr(10)) as l from documents)),
paragraphs as (select doc_id, 'paragraph' as unit, unnest(range(len(l))) as place, unnest(l) as body from (select doc_id, string_split_regex(lower(text), '\n[ \t\r]*\n') as l from documents)),
units as (select * from lines union all select * from paragraphs where contains(body, chr(10))),
u as (select doc_id, unit, place, {grams} as g from (select *, regexp_extract_all(body, '[\p{{L}}\p{{N}}]+') as w from units where regexp_matches(body, 'licen[cs]e|permission|software|copyright|redistribution|warrant|commercial|mozilla|attribution|unencumbered|cc '))),
d as (select doc_id, unit, place, licence, wording, round(2.0 * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)), 6) as dice from u, t),
pw as (select doc_id, place, regexp_extract_all(body, '[\p{{L}}\p{{N}}]+') as words from paragraphs),
hit as (select distinct doc_id, place, words, licence, wording, p - stands as start, n from (select doc_id, place, words, unnest(range(len(words))) as p, unnest(words) as word from pw) join a using (word)),
wi as (select doc_id, 'window' as unit, place, h.licence, h.wording, {grams} as g from (select *, words[greatest(start, 0) + 1 : start + n] as w from hit) h),
x as (select wi.doc_id, unit, place, wi.licence, wi.wording, round(2.0 * len(list_intersect(wi.g, t.g)) / (len(wi.g) + len(t.g)), 6) as dice from wi join t on wi.licence = t.licence and wi.wording = t.wording),
s as (select doc_id, 'spdx' as unit, unnest(range(len(l))) as place, unnest(l) as licence, -1 as wording, 1.0 as dice from (select doc_id, regexp_extract_all(text, '{SPDX}', 1) as l from documents))
select doc_id, unit, place::int as place, licence, wording::int as wording, dice::double as dice from (select * from d union all select * from x union all select * from s) where dice >= {least}
"""
