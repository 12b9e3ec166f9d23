"""License scans (operator 10): an exact set-similarity join of text blocks with license templates, DataFrame only.

Blocks are overlapping windows over all words of a text, across line ends: every stretch of as many words as the longest
template's reach lies in one. Template words are ordered by their frequency over all blocks, rarest first; of a template of n
words of which a must be in a stretch, only the first n - a + 1 words (its prefix) are joined, since what has none of them
cannot hold a others. Length and positional filters (of the block's words, those from the matched one on in that order have to
suffice) come before the count, which is over stretches of up to ``REACH`` times the template's own length. Every stretch that holds the threshold's
share of a template's words is found; no word has to be there.

What is found may be another license, as they share sentences. So a template may come with contrasts: the same sentence of other
licenses, or without the words that name one. They are counted over the same stretch, and the largest share (then the longer
sentence) says what it is; a contrast gives no label.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Base phrases: label and words that stand consecutively.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Sentences of well-known licenses that the join looks for, each with its label and its contrasts.
SENTENCES = [
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", [
        "This work is licensed under the GNU General Public License, version",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ]),
    ("gpl-3", "either version 3 of the GNU General Public License, or (at your option) any later version", [
        "either version of the GNU General Public License, or (at your option) any later version",
        "either version 3 of the GNU Lesser General Public License, or (at your option) any later version",
        "either version 3 of the GNU Affero General Public License, or (at your option) any later version",
    ]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", []),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", []),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", []),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.", [
        "This software is provided as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability and fitness for a particular purpose.",
    ]),
    ("mit", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.", []),
    ("mit", "Released under the MIT License.", ["Released under the License."]),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ["Licensed under the Apache License, Version", "Licensed under the License, Version"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", [
        "Licensed under the Apache License, Version (the License); you may not use this file except in compliance with the License.",
        "Licensed under the License, Version (the License); you may not use this file except in compliance with the License.",
    ]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", []),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", []),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", []),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", []),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.", []),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", []),
    ("isc", "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.", []),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["Licensed under CC BY 4.0."]),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", [
        "licensed under a Creative Commons Attribution International License",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", []),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["This Source Code Form is subject to the terms of the Mozilla Public License, v."]),
    ("mpl-2", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", []),
    ("unlicense", "This is free and unencumbered software released into the public domain.", []),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", []),
    ("all-rights-reserved", "All rights reserved.", []),
]
TEMPLATES = [(label, sentence) for label, sentence, _ in SENTENCES]
CONTRASTS = {sentence: contrasts for _, sentence, contrasts in SENTENCES}
#: Share of a template's words that a stretch has to hold.
CONTAINMENT = 0.8
#: These words have to stand within so many times the template's length (rounded down, at least the length).
REACH = 1.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _all_words_of(sentence: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in sentence.lower()).split()


def _words_of(sentence: str) -> list[str]:
    return list(dict.fromkeys(_all_words_of(sentence)))


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``x``, which is computed once however often ``then`` names it."""
    return F.transform(F.array(x), then)[0]


def _joined(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _blanks(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def _needed(words: list[str], containment: float) -> int:
    return -(-round(containment * 1000) * len(words) // 1000)


def _family(sentence: str, contrasts: list[str]) -> int:
    """Words that a stretch has: the longest reach of a template and its contrasts."""
    return max(max(int(REACH * n), n) for n in (len(_all_words_of(s)) for s in (sentence, *contrasts)))


def _windows(x: str, reach: int, vocabulary: list[str]) -> Column:
    """Blocks of a text: the word each starts at, and its words of templates with their places. A block starts at every reach-th word and holds
    each stretch of up to reach words that starts before the next one."""
    slices = _let(F.split(F.trim(x), " ", -1), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(reach)), lambda s: F.struct(s.alias("start"), F.slice(w, s + 1, 2 * reach).alias("text"))))
    return F.transform(slices, lambda b: F.struct(b["start"].alias("start"), F.filter(F.transform(b["text"], lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda t: t["w"].isin(vocabulary)).alias("words")))


def _set(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda t: t["w"]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = CONTAINMENT, contrasts: dict[str, list[str]] = CONTRASTS) -> DataFrame:
    """doc_id, n_words, n_base (places of all base phrases), first_word and last_word (smallest and largest start, words
    from 0; null without any), base_labels, labels (base ones and the join's; both distinct, sorted, comma-joined),
    score (1 with a base phrase, else the best containment of a template found, else 0) and blocks (array of what was
    found, for a template at most the best of each block: word it starts at, label, containment).

    A null text counts as empty: no words, no labels. One row for every row of ``docs``, whatever its doc_id; other
    columns are left out. An empty table gives an empty result. Texts are read twice: for the words' frequencies, of which
    the driver gets one for each template word, and for the join.
    """
    spark = docs.sparkSession
    sets = [(i, label, _words_of(s), _needed(_words_of(s), containment), _family(s, contrasts.get(s, []))) for i, (label, s) in enumerate(templates)]
    members = [[(_words_of(c), "" if k else label) for k, c in enumerate([s, *contrasts.get(s, [])])] for label, s in templates]
    reach, least = max(r for *_, r in sets), min(a for *_, a, _ in sets)
    vocabulary = sorted({w for family in members for words, _ in family for w in words})
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.withColumn("x", F.concat(F.lit(" "), F.trim(F.regexp_replace("t", _GAP, " ")), F.lit(" ")))

    held = rows.select(F.explode(_windows("x", reach, vocabulary)).alias("b")).select(F.explode(_set(F.col("b.words"))).alias("word"))
    frequency = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # words of templates only
    ranked = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    place = {w: i for i, w in enumerate(ranked)}
    prefixes = []
    for i, _, words, needed, _ in sets:
        rare = sorted(words, key=place.__getitem__)
        prefixes += [(i, w, rare[: k + 1], [x for x in ranked if place[x] >= place[w] and x in set(words)]) for k, w in enumerate(rare[: len(words) - needed + 1])]
    first = sorted({w for _, w, _, _ in prefixes})

    n_words = F.when(F.col("x") == "  ", F.lit(0)).otherwise(_blanks(F.col("x")) - 1).cast("long")
    columns, counts, firsts, lasts = [], [], [], []
    for i, phrase in enumerate(phrases.values()):
        padded = f" {phrase} "
        has = F.contains("x", F.lit(padded))
        counts.append(F.when(has, F.regexp_count("x", F.lit(f" {phrase}(?= )"))).otherwise(F.lit(0)).cast("long"))
        firsts.append(F.when(has, _blanks(F.substr("x", F.lit(1), F.instr("x", padded))) - 1))
        at = F.length("x") - F.instr(F.reverse("x"), padded[::-1]) - len(padded) + 2
        lasts.append(F.when(has, _blanks(F.substr("x", F.lit(1), at)) - 1))
        columns.append(has.alias(f"_has{i}"))
    labels = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_has{i}"), F.lit(label)) for i, label in enumerate(phrases)])))
    blocks = F.filter(_windows("x", reach, vocabulary), lambda b: F.exists(b["words"], lambda t: t["w"].isin(first)) & (F.size(_set(b["words"])) >= least))
    found = rows.select("row", "doc_id", n_words.alias("n_words"), reduce(lambda a, b: a + b, counts).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), *columns, blocks.alias("windows"))
    found = staged(found.withColumn("base", labels).drop(*[f"_has{i}" for i in range(len(phrases))]), "licenses")

    prefix = spark.createDataFrame(prefixes, "template int, word string, until array<string>, from_here array<string>")
    family = "array<struct<words:array<string>,label:string>>"
    template = spark.createDataFrame([(*row, m) for row, m in zip(sets, members, strict=True)], f"template int, label string, t_words array<string>, needed int, t_reach int, members {family}")
    joined = F.broadcast(prefix.join(template, "template"))  # a row for each word of a prefix
    block = found.select("row", F.explode("windows").alias("b")).select("row", "b.start", F.col("b.words").alias("tagged"), _set(F.col("b.words")).alias("words"))
    candidates = block.withColumn("word", F.explode("words")).join(joined, "word")
    # length: the block has enough words; a block and a template meet once, at the rarest prefix word that they share
    candidates = candidates.filter((F.size("words") >= F.col("needed")) & (F.size(F.array_intersect("until", "words")) == 1))
    # position: of the template's words, those from the matched one on in rising frequency suffice
    candidates = candidates.filter(F.size(F.array_intersect("words", "from_here")) >= F.col("needed"))
    starts = F.filter("tagged", lambda t: (t["i"] < reach) & F.array_contains("t_words", t["w"]))
    near = F.transform(starts, lambda s: F.struct(s["i"].alias("s"), _set(F.filter("tagged", lambda t: (t["i"] >= s["i"]) & (t["i"] < s["i"] + F.col("t_reach")))).alias("w")))
    near = F.filter(near, lambda n: F.size(F.array_intersect(n["w"], "t_words")) >= F.col("needed"))
    judged = F.transform(near, lambda n: F.struct(n["s"].alias("s"), F.array_max(F.transform("members", lambda m: F.struct((F.size(F.array_intersect(n["w"], m["words"])) / F.size(m["words"])).alias("share"), F.size(m["words"]).alias("size"), m["label"].alias("label")))).alias("best")))
    own = F.filter(judged, lambda j: j["best"]["label"] != "")
    hits = candidates.select("row", "label", "start", F.array_max(F.transform(own, lambda j: F.struct(j["best"]["share"].alias("share"), (-j["s"]).alias("before")))).alias("best")).filter("best is not null")
    hits = hits.select("row", "label", (F.col("start") - F.col("best.before")).alias("word"), "best.share")
    per_row = hits.groupBy("row").agg(F.collect_set("label").alias("joined"), F.max("share").alias("best"), F.array_sort(F.collect_set(F.struct("word", "label", "share"))).alias("blocks"))
    out = found.select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base").join(per_row, "row", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("joined", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"), F.coalesce("blocks", F.array().cast("array<struct<word:int,label:string,share:double>>")).alias("blocks"))


def _oracle() -> str:
    """The query's rows in DuckDB's SQL: every stretch of every text that starts at a template's word, against that template and its contrasts."""
    sql = lambda words: "[" + ", ".join(repr(w) for w in words) + "]"
    families, members = [], []
    for i, (label, s, others) in enumerate(SENTENCES):
        families.append(f"({i}, {sql(_words_of(s))}, {_needed(_words_of(s), CONTAINMENT)}, {_family(s, others)})")
        members += [f"({i}, '{'' if k else label}', {sql(_words_of(c))})" for k, c in enumerate([s, *others])]
    places = " UNION ALL ".join(
        f"SELECT row, '{label}' AS label, i - 1 AS pos FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM tokens) WHERE w[i:i+{len(p.split()) - 1}] = {sql(p.split())}"
        for label, p in PHRASES.items()
    )
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
tokens AS (SELECT row, regexp_extract_all(t, '{pattern}') AS w FROM docs),
places AS ({places}),
base AS (SELECT row, count(*) AS n, min(pos) AS a, max(pos) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY row),
families(family, tw, needed, reach) AS (VALUES {", ".join(families)}),
members(family, label, mw) AS (VALUES {", ".join(members)}),
words AS (SELECT family, reach, needed, tw, unnest(tw) AS word FROM families),
spread AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM tokens),
stretches AS (SELECT row, family, tw, needed, i, list_distinct(w[i:i + reach - 1]) AS s FROM spread JOIN words USING (word)),
enough AS (SELECT * FROM stretches WHERE len(list_intersect(s, tw)) >= needed),
judged AS (
  SELECT row, family, i, label, len(list_intersect(s, mw)) / len(mw) AS share, row_number() OVER (PARTITION BY row, family, i ORDER BY len(list_intersect(s, mw)) / len(mw) DESC, len(mw) DESC, label DESC) AS place
  FROM enough JOIN members USING (family)),
joined AS (SELECT row, label, share FROM judged WHERE place = 1 AND label <> ''),
best AS (SELECT row, max(share) AS share FROM joined GROUP BY row),
every AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM places UNION ALL SELECT row, label FROM joined) GROUP BY row)
SELECT d.doc_id, len(k.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.a::BIGINT AS first_word, b.b::BIGINT AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0)::DOUBLE END AS score
FROM docs d JOIN tokens k USING (row) LEFT JOIN base b USING (row) LEFT JOIN every e USING (row) LEFT JOIN best USING (row)
"""


ORACLE = _oracle()
