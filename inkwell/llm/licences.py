"""Licence scan: a trained paragraph classifier with template comparison, in DataFrame operations only.

A paragraph is a run of lines: a line break ends it if a blank line follows or
the line before ends in one of . ! ? : (a wrapped notice is one paragraph; marks
of comments at the start of lines don't count). Paragraphs are scored by a
multinomial logistic regression on their distinct word 1- to 3-grams: one class
a licence family and one for everything else. Weights are whole numbers
(thousandths), so every engine gets the same sums. A family is predicted if it
scores highest and beats the unknown class by a margin that is calibrated on
held-out paragraphs: at most one unknown paragraph in 200 passes it. A
prediction is confirmed by comparison with the family's templates: at least
``COVER`` of a template's distinct word pairs stand in the paragraph.

Texts and paragraphs without any of ``gate_words`` are left out first. That
loses nothing: the words are chosen so that, of every template, more than
1 - ``COVER`` of the pairs hold one of them, and a paragraph without them all
has less than ``COVER`` of any template.

The model is trained on the driver with numpy from the templates below, cut,
thinned and mixed with other words, against lines that use the same words
otherwise; their number is a parameter and does not depend on the input. The
main path has no Python: documents pass the gate inside the scan's
stage, only their paragraphs are exploded, and weights and template pairs (some
ten thousand rows, fixed by the templates) are broadcast.

Defined results: null texts and texts without a notice give an empty list and a
count of zero; rows with one id share their findings; repeated rows give a row
each; a null id gets its own row with what null ids hold together; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notice texts of licence families.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Licensed under the GPLv2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "BSD": [
        "Licensed under the BSD License.",
        "Released under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, you can obtain one under the Mozilla Public License.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal license.",
        "Licensed under CC0 1.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright (c) 2024. All rights reserved.",
        "This document is proprietary and confidential. Unauthorized copying or redistribution is prohibited.",
    ],
}

#: Lines that use the words of licences otherwise, and words to mix in.
OTHERWISE = [
    "he lost his driving licence last year", "copyright law protects the authors of books", "the device comes with a two year warranty",
    "she asked for permission to leave early", "the court issued a warrant for his arrest", "this is no license to be rude", "apache helicopters crossed the river",
    "licensed drivers must renew every ten years", "the rights of workers were reserved for later talks", "a fishing license costs ten euros",
    "the museum keeps works from the public domain debate", "their confidential meeting took all day", "the copyright office opens at nine",
    "redistribution of wealth is a matter of debate", "license plates are made of metal", "a proprietary blend of herbs", "the license fee rose again",
]
STOP = frozenset("a an the of to in and or is are be it its on for with this that by as at from you he she they we was not no all".split())

UNKNOWN = "unknown"
COVER = 0.6
TRAINING_LINES = 4000


def words_of(text: str) -> list[str]:
    out, word = [], []
    for c in text:
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "a" <= c <= "z" or "0" <= c <= "9":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out + (["".join(word)] if word else [])


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


@lru_cache(maxsize=4)
def model(lines: int = TRAINING_LINES, seed: int = 3, rounds: int = 120) -> tuple[dict[str, dict[str, int]], dict[str, int], int]:
    """Weights (gram -> family -> thousandths), biases and the calibrated margin."""
    rng = random.Random(seed)
    fill = [w for t in OTHERWISE for w in t.split()] + ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(300)]
    families = sorted(TEMPLATES)

    def mixed(words: list[str]) -> list[str]:
        words = [w for w in words if rng.random() > 0.08]
        if len(words) > 14 and rng.random() < 0.4:
            cut = rng.randint(10, len(words))
            at = rng.randint(0, len(words) - cut)
            words = words[at : at + cut]
        before, after = ([rng.choice(fill) for _ in range(rng.choice([0, 0, 2, 8, 30]))] for _ in range(2))
        return before + words + after

    made: list[tuple[set[str], str]] = []
    for i in range(lines):
        if i % 2:
            family = rng.choice(families)
            made.append((grams_of(mixed(words_of(rng.choice(TEMPLATES[family])))), family))
        else:
            base = rng.choice(OTHERWISE).split() if rng.random() < 0.7 else []
            own = [w for t in TEMPLATES[rng.choice(families)] for w in words_of(t)]
            base += rng.sample(own, min(len(own), rng.choice([0, 1, 2, 4])))  # their words, not their phrases
            rng.shuffle(base)
            made.append((grams_of(mixed(base)), UNKNOWN))
    held, train = made[: lines // 4], made[lines // 4 :]
    known = {g for t in TEMPLATES.values() for x in t for g in grams_of(words_of(x))} | {g for x in OTHERWISE for g in grams_of(x.split())}
    names = {g: i for i, g in enumerate(sorted(g for g in known if not set(g.split()) <= STOP))}
    classes = [*families, UNKNOWN]

    def rows(some: list[tuple[set[str], str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = [np.array(sorted(names[g] for g in s if g in names), np.int64) for s, _ in some]
        at = np.repeat(np.arange(len(some)), [len(c) for c in cols])
        return at, np.concatenate(cols), np.array([classes.index(y) for _, y in some])

    at, col, y = rows(train)
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    w_speed, b_speed = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    order = np.argsort(col, kind="stable")
    present, begin = np.unique(col[order], return_index=True)
    lines_at = np.searchsorted(at, np.arange(len(train) + 1))
    full = lines_at[:-1] < lines_at[1:]

    def scores(at_: np.ndarray, col_: np.ndarray, n: int) -> np.ndarray:
        out = np.tile(b, (n, 1))
        np.add.at(out, at_, w[col_])
        return out

    for _ in range(rounds):
        z = np.tile(b, (len(train), 1))
        z[full] += np.add.reduceat(w[col], lines_at[:-1][full], axis=0)
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        grad = 2e-5 * w
        grad[present] += np.add.reduceat(z[at[order]], begin, axis=0)
        w_speed += grad * grad
        w -= 0.4 * grad / np.sqrt(w_speed)
        g = z.sum(0)
        b_speed += g * g
        b -= 0.4 * g / np.sqrt(b_speed)
    whole, whole_b = np.rint(1000 * w).astype(int), np.rint(1000 * b).astype(int)
    at, col, y = rows(held)
    z = np.tile(whole_b, (len(held), 1))
    np.add.at(z, at, whole[col])
    lead = np.sort((z[:, :-1].max(1) - z[:, -1])[y == len(classes) - 1])
    margin = max(0, int(lead[int(len(lead) * 0.995)]) + 1)
    weights = {g: {c: int(whole[i, k]) for k, c in enumerate(classes) if whole[i, k]} for g, i in names.items()}
    return {g: x for g, x in weights.items() if x}, dict(zip(classes, whole_b.tolist(), strict=True)), margin


def template_pairs() -> list[tuple[str, int, str, int]]:
    """family, template, word pair, number of the template's pairs."""
    out, number = [], 0
    for family in sorted(TEMPLATES):
        for text in TEMPLATES[family]:
            words = words_of(text)
            pairs = sorted({" ".join(words[i : i + 2]) for i in range(len(words) - 1)})
            out += [(family, number, p, len(pairs)) for p in pairs]
            number += 1
    return out


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A line's start with marks of comments, and a break inside a paragraph.
_MARKS = r"\r?\n[ \t]*(?:(?://+|#+|/?\*+|--+|;+|%+|<!--)[ \t]*)?"
_WRAP = r"([^\n.!?:])\n([^\n])"


@lru_cache(maxsize=1)
def gate_words() -> tuple[str, ...]:
    """Words without one of which no paragraph can be confirmed, fewest first found by greedy choice."""
    templates: dict[int, list[tuple[str, ...]]] = {}
    for _, number, pair, _ in template_pairs():
        templates.setdefault(number, []).append(tuple(pair.split()))
    short = {n: len(pairs) - math.ceil(COVER * len(pairs) - 1e-9) + 1 for n, pairs in templates.items()}  # pairs that must hold a gate word
    words = sorted({w for pairs in templates.values() for p in pairs for w in p if len(w) > 1 and w not in STOP and not w.isdigit()})
    chosen: list[str] = []

    def held(some: list[str]) -> dict[int, int]:
        return {n: sum(not set(some).isdisjoint(p) for p in pairs) for n, pairs in templates.items()}

    while True:
        now = held(chosen)
        if all(now[n] >= short[n] for n in short):
            return tuple(chosen)
        gain = lambda w: sum(min(short[n], x) - min(short[n], now[n]) for n, x in held([*chosen, w]).items())  # noqa: B023, E731
        best = max(words, key=lambda w: (gain(w) * min(len(w), 8), w))  # longer words are rarer elsewhere
        if not gain(best):
            raise ValueError("a template has too few words of its own for the gate")
        chosen.append(best)


def _has_word(text: Column) -> Column:
    """Whether a text holds a gate word; the lower case is taken once."""

    def test(low: Column) -> Column:
        out = F.lit(False)
        for w in gate_words():
            out = out | low.contains(w)
        return out

    return F.coalesce(F.exists(F.array(F.translate(text, _UPPER, _LOWER)), test), F.lit(False))


def paragraphs(text: Column) -> Column:
    """A text's paragraphs, each on one line."""
    return F.split(F.regexp_replace(F.regexp_replace(text, _MARKS, "\n"), _WRAP, "$1 $2"), "\n")


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as a literal of the plan."""
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_ddl(schema)}>>")))


def _ddl(schema: str) -> str:
    return ", ".join(c.strip().replace(" ", ":", 1) for c in schema.split(","))


def notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line (the paragraph's number, from 0), family of every confirmed notice."""
    spark = docs.sparkSession
    weights, bias, margin = model()
    table = _literal(spark, [{"gram": g, "class": c, "weight": v} for g, x in weights.items() for c, v in x.items()], "gram string, class string, weight bigint")
    biases = _literal(spark, [{"class": c, "bias": v} for c, v in bias.items()], "class string, bias bigint")
    pairs = _literal(spark, [dict(zip(("family", "template", "gram", "n"), r, strict=True)) for r in template_pairs()], "family string, template int, gram string, n int")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(_has_word(F.col("text")))
    # a line is told apart by a number of its row; the id is not unique
    lines = rows.withColumn("row", F.xxhash64("text")).select("doc_id", "row", F.posexplode(paragraphs(F.col("text"))).alias("line", "paragraph")).distinct()
    lines = lines.filter(_has_word(F.col("paragraph")))
    words = F.regexp_extract_all(F.translate("paragraph", _UPPER, _LOWER), F.lit("[a-z0-9]+"), 0)
    lines = lines.select("doc_id", "row", "line", words.alias("w")).filter(F.arrays_overlap("w", F.array(*map(F.lit, gate_words()))))
    n = F.size("w")
    gram = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, size), " "))
    pairs_of = F.when(n > 1, gram(2)).otherwise(F.array())
    some = F.array_distinct(F.concat(gram(1), pairs_of, F.when(n > 2, gram(3)).otherwise(F.array())))
    key = ["doc_id", "row", "line"]
    grams = lines.select(*key, F.explode(some).alias("gram"))

    summed = grams.join(F.broadcast(table), "gram").groupBy(*key, "class").agg(F.sum("weight").alias("weight"))
    # a class without any gram of the line has its bias alone; the unknown class always stands
    found = summed.join(F.broadcast(biases), "class").withColumn("score", F.col("weight") + F.col("bias"))
    unknown = F.coalesce(F.max(F.when(F.col("class") == UNKNOWN, F.col("score"))), F.lit(bias[UNKNOWN]))
    best = F.min(F.when(F.col("class") != UNKNOWN, F.struct((-F.col("score")).alias("s"), F.col("class").alias("family"))))
    judged = found.groupBy(*key).agg(best.alias("best"), unknown.alias("unknown"))
    predicted = judged.filter(-F.col("best.s") - F.col("unknown") >= margin).select(*key, F.col("best.family").alias("family"))

    again = predicted.select(*(F.col(k).alias(f"p_{k}") for k in key), "family")
    both = lines.join(again, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in key]).select(*key, "family", F.explode(F.array_distinct(pairs_of)).alias("gram"))
    cover = both.join(F.broadcast(pairs), ["family", "gram"]).groupBy(*key, "family", "template").agg((F.count(F.lit(1)) / F.first("n")).alias("cover"))
    return cover.groupBy(*key, "family").agg(F.max("cover").alias("cover")).filter(F.col("cover") >= COVER).select("doc_id", "line", "family", "cover", "row")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, families (sorted, joined by |), n_notices of every row."""
    found = notices(docs, id_col, text_col).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("family")), "|").alias("families"), F.count(F.lit(1)).alias("n"))
    ids = docs.select(F.col(id_col).alias("doc_id"))
    joined = ids.join(found.withColumnRenamed("doc_id", "found_id"), ids.doc_id.eqNullSafe(F.col("found_id")), "left")
    return joined.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n", F.lit(0)).cast("long").alias("n_notices"))


def oracle_sql() -> str:
    """The scan of table documents in DuckDB SQL, with the model's numbers in it."""
    weights, bias, margin = model()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    w = ", ".join(f"({q(g)}, {q(c)}, {v})" for g, x in sorted(weights.items()) for c, v in sorted(x.items()))
    b = ", ".join(f"({q(c)}, {v})" for c, v in sorted(bias.items()))
    p = ", ".join(f"({q(f)}, {t}, {q(g)}, {n})" for f, t, g, n in template_pairs())
    gate = " OR ".join(f"contains(translate(paragraph, '{_UPPER}', '{_LOWER}'), {q(w)})" for w in gate_words())
    joined = f"regexp_replace(regexp_replace(text, {q(_MARKS)}, chr(10), 'g'), {q(_WRAP)}, '\\1 \\2', 'g')"
    return f"""
        WITH weights(gram, class, weight) AS (VALUES {w}),
        biases(class, bias) AS (VALUES {b}),
        pairs(family, template, gram, n) AS (VALUES {p}),
        split_lines AS (
            SELECT doc_id, unnest(string_split(joined, chr(10))) AS paragraph
            FROM (SELECT doc_id, {joined} AS joined FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))
        ), chosen AS (
            SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(paragraph, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') AS w
            FROM split_lines WHERE {gate}
        ), grams AS (
            SELECT DISTINCT k, doc_id, gram FROM (
                SELECT k, doc_id, unnest(w) AS gram FROM chosen
                UNION ALL SELECT k, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM chosen
                UNION ALL SELECT k, doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM chosen
            )
        ), summed AS (
            SELECT k, doc_id, class, sum(weight) AS weight FROM grams JOIN weights USING (gram) GROUP BY ALL
        ), scored AS (
            SELECT k, doc_id, class, weight + bias AS score FROM summed JOIN biases USING (class)
        ), judged AS (
            SELECT k, doc_id, coalesce(max(score) FILTER (class = '{UNKNOWN}'), {bias[UNKNOWN]}) AS unknown,
                   arg_min(class, (-score, class)) FILTER (class <> '{UNKNOWN}') AS family, max(score) FILTER (class <> '{UNKNOWN}') AS best
            FROM scored GROUP BY ALL
        ), predicted AS (
            SELECT k, doc_id, family FROM judged WHERE best - unknown >= {margin}
        ), cover AS (
            SELECT g.k, g.doc_id, r.family, p.template, count(*) / max(p.n) AS cover
            FROM predicted r JOIN grams g ON g.k = r.k JOIN pairs p ON p.family = r.family AND p.gram = g.gram GROUP BY ALL
        ), confirmed AS (
            SELECT k, doc_id, family FROM cover GROUP BY ALL HAVING max(cover) >= {COVER}
        ), found AS (
            SELECT doc_id, string_agg(DISTINCT family, '|' ORDER BY family) AS families, count(*) AS n FROM confirmed GROUP BY ALL
        )
        SELECT d.doc_id, coalesce(f.families, '') AS families, CAST(coalesce(f.n, 0) AS BIGINT) AS n_notices
        FROM documents d LEFT JOIN found f ON d.doc_id IS NOT DISTINCT FROM f.doc_id
    """
