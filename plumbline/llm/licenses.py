"""License scans in Spark expressions only: MinHash bands over overlapping windows retrieve templates, shingles verify.

Templates are grouped by length; each group has its own window (an eighth longer than its longest template, so one of the
windows that start at every eighth holds any occurrence whole). A window that holds enough of a template shares one of the
bands of ROWS MinHash values with it with a probability of at least 1 - MISS: `settings` works out from the lengths and the
threshold how alike the two must be and how many bands that takes. Exact containment then decides.

Windows are laid only where a match can be. A match lacks few of a template's shingles; so of any larger choice of them it
holds at least the difference. Such a choice, the shingles that begin with the longest words, is fixed for each template, and
only windows with enough of its group's chosen shingles are hashed: that loses nothing. Of templates with over SKETCH
shingles a bottom sketch is chosen instead, the SKETCH smallest hashes, of which a match holds `similar` on average: a
quarter of that is asked for, which it has but for a chance far below MISS, as what it lacks has nothing to do with hashes.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
SIMILAR = 0.8
#: MinHash values in a band, and the chance that a window which holds enough of a template shares no band with it.
ROWS, MISS = 2, 1e-4
#: Chosen shingles of a long template. They begin with words of LONG letters or more, as far as it has such.
SKETCH, LONG = 48, 6
#: Names and texts of widely used license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "reserved": "All rights reserved.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
}
#: Names that short forms use, by SPDX id.
NAMES = {
    "MIT": "the MIT License", "BSD": "the BSD License", "BSD-2-Clause": "the BSD 2-Clause License", "BSD-3-Clause": "the BSD 3-Clause License", "ISC": "the ISC License", "Zlib": "the zlib License",
    "Apache-2.0": "the Apache License, Version 2.0", "MPL-2.0": "the Mozilla Public License, Version 2.0", "Artistic-2.0": "the Artistic License 2.0", "Unlicense": "the Unlicense",
    "GPL-2.0": "the GNU General Public License, version 2", "GPL-3.0": "the GNU General Public License, version 3", "LGPL-2.1": "the GNU Lesser General Public License, version 2.1", "LGPL-3.0": "the GNU Lesser General Public License, version 3", "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "CC0-1.0": "CC0 1.0", "CC-BY-3.0": "CC BY 3.0", "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-3.0": "CC BY-SA 3.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-ND-4.0": "CC BY-ND 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0", "CC-BY-NC-ND-4.0": "CC BY-NC-ND 4.0",
}
#: Full texts, named by SPDX id (files of fixed size, read on the driver).
BODIES = Path(__file__).parent / "license_texts"


def production() -> dict[str, str]:
    """TEMPLATES, a short form of every name with either verb, and the full bodies; equal wordings once."""
    short = {f"{k}-{verb.lower()}": f"{verb} under {name}." for k, name in NAMES.items() for verb in ("Licensed", "Released")}
    bodies = {f"{f.stem}-body": f.read_text(encoding="utf-8", errors="replace") for f in sorted(BODIES.glob("*.txt"))}
    known = {tuple(words_of(t)) for t in TEMPLATES.values()}
    return TEMPLATES | {k: t for k, t in (short | bodies).items() if tuple(words_of(t)) not in known}


def words_of(text: str) -> list[str]:
    """Runs of ASCII letters and digits, in lower case."""
    return re.findall(r"[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles_of(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))})


def missing(n: int, similar: float) -> int:
    """Shingles of n that a match may lack."""
    return n - math.ceil(similar * n - 1e-9)


def chosen(words: list[str], similar: float) -> tuple[list[str], int]:
    """Shingles of a template, and how many of them a window with a match holds.

    An eighth more of them than a match may lack (one at least), those with the longest, as a rule the rarest, first words; of a long template a sketch.
    """
    s = sorted(shingles_of(words), key=lambda x: (-len(x.split()[0]), x))
    if len(s) > SKETCH:
        far = [x for x in s if len(x.split()[0]) >= LONG]
        s = sorted(far if len(far) >= SKETCH else s, key=lambda x: hashlib.md5(x.encode()).digest())[:SKETCH]
        return s, max(1, int(similar * SKETCH / 4))
    some = missing(len(s), similar) + max(1, len(s) // 8)
    return s[:some], len(s[:some]) - missing(len(s), similar)


def groups(templates: dict[str, str]) -> list[tuple[int, int, list[tuple[str, list[str]]]]]:
    """(window, step, templates) by length: each group's longest is at most a fifth longer than its shortest, and texts of under ten words stand by their length."""
    todo = sorted(((k, w) for k, t in templates.items() if (w := words_of(t))), key=lambda x: (len(x[1]), x[0]))
    out: list[list[tuple[str, list[str]]]] = []
    for x in todo:
        near = out and (len(x[1]) == len(out[-1][0][1]) if len(out[-1][0][1]) < 2 * SHINGLE else len(x[1]) <= 1.2 * len(out[-1][0][1]))
        out[-1].append(x) if near else out.append([x])
    steps = [max(1, len(g[-1][1]) // 8) if len(g[0][1]) >= 2 * SHINGLE else 1 for g in out]
    return [(len(g[-1][1]) + s - 1, s, g) for g, s in zip(out, steps, strict=True)]


def settings(sets: list, similar: float) -> tuple[int, int]:
    """(bands, rows): enough bands for the least resemblance that a window with a match can have, all its other shingles being new."""
    least = 1.0
    for size, _, group in sets:
        for _, ws in group:
            n, k = len(shingles_of(ws)), min(SHINGLE, len(ws))
            held = n - missing(n, similar)
            least = min(least, held / max(n, n + size - k + 1 - held))
    rows = ROWS if least >= 0.4 else 1
    return max(1, math.ceil(math.log(MISS) / math.log(1 - min(least, 0.999) ** rows))), rows


def minhashes(hashes: Column, n: int) -> Column:
    seeded = lambda k: lambda h: F.xxhash64(h, F.lit(k))
    return F.array(*[F.array_min(F.transform(hashes, seeded(k))) for k in range(n)])


def bands(signature: Column, n: int, rows: int) -> Column:
    return F.array(*[F.xxhash64(F.lit(b), *[F.get(signature, F.lit(b * rows + r)) for r in range(rows)]) for b in range(n)])


def shingle_at(words: Column, k: int):
    """The hash of the k words from place i on, x being the first."""
    return lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, k)])


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, template, containment, first_word, windows): a row for each document and template with a window that holds
    at least `similar` of the template's distinct five-word shingles; the best containment, the first word (from 0) of the
    first best window, and the number of windows above the threshold.

    Whole texts, in lower case, by their runs of ASCII letters and digits. Templates of under five words are one shingle
    and match as a whole. Null and empty texts hold nothing. Every row is a document of its own: repeated ones give
    repeated rows, and rows without an id are told apart. Templates are parameters of the plan (under 1000, or ValueError), never read from the corpus.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) >= 1000:
        raise ValueError("give the templates in parts of under 1000")
    if not 0 < similar <= 1:
        raise ValueError("similar must be above 0, 1 at most")
    spark, sets = docs.sparkSession, groups(templates)
    if not sets:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, template string, containment double, first_word long, windows long")
    n_bands, rows = settings(sets, similar)
    length = [min(SHINGLE, len(group[0][1])) for *_, group in sets]
    own = choices(spark, sets, similar)  # of each group: (first word, hash) of its chosen shingles
    lows = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = F.col("_w")
    some = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.filter(F.split(lows, "[^a-z0-9]+"), lambda x: x != "").alias("_w"))
    every = {k: [c for g, c in enumerate(own) if length[g] == k] for k in sorted(set(length))}

    def met(x: Column, i: Column) -> Column:
        here = [F.when(h.isin(sorted({b for c in found for _, b in c})), F.struct(i.alias("i"), h.alias("h"))) for k, found in every.items() for h in [shingle_at(w, k)(x, i)]]
        return F.when(x.isin(sorted({a for c in own for a, _ in c})), F.filter(F.array(*here), lambda a: a.isNotNull()))

    hits = F.flatten(F.filter(F.transform(w, met), lambda a: a.isNotNull()))
    # no filter on the hits: pushed below, it would split the text again at every word
    some = some.withColumn("_a", hits)
    for k in every:
        some = some.withColumn(f"_h{k}", F.when(F.size("_a") > 0, F.transform(w, shingle_at(w, k))))

    of = lambda values, g: F.get(F.array(*map(F.lit, values)), g)
    size, step, k, need, least = ([f(g) for g in range(len(sets))] for f in (
        lambda g: sets[g][0], lambda g: sets[g][1], lambda g: length[g],
        lambda g: min(chosen(ws, similar)[1] for _, ws in sets[g][2]),
        lambda g: min(n - missing(n, similar) for _, ws in sets[g][2] for n in [len(shingles_of(ws))]),
    ))

    def places(a: Column) -> Column:
        """Windows {g, t} that hold the hit. They start at multiples t of the step; the last ones may be cut short by the text's end."""
        reach = lambda g: F.sequence(F.ceil(F.greatest(a["i"] + (k[g] - size[g]), F.lit(0)) / step[g]), F.floor(a["i"] / step[g]))
        tagged = lambda g: F.transform(reach(g), lambda t: F.struct(F.lit(g).alias("g"), t.alias("t")))
        return F.flatten(F.filter(F.array(*[F.when(a["h"].isin(sorted({b for _, b in own[g]})), tagged(g)) for g in range(len(sets))]), lambda x: x.isNotNull()))

    # columns of their own, as lambdas below look into them: every window once for each of its hits, in order
    some = some.withColumn("_s", F.sort_array(F.flatten(F.transform("_a", places))))
    enough = lambda v, j: F.when((F.get("_s", j + of(need, v["g"]) - 1) == v) & (F.size(w) - v["t"] * of(step, v["g"]) >= of(least, v["g"])), v)
    some = some.select("doc_id", "_row", *[f"_h{x}" for x in every], F.array_distinct(F.filter(F.transform("_s", enough), lambda v: v.isNotNull())).alias("_v"))

    def window(v: Column) -> Column:
        g, at = v["g"], (v["t"] * of(step, v["g"])).cast("int")
        inside = reduce(lambda rest, x: F.when(of(k, g) == x, F.slice(f"_h{x}", at + 1, of(size, g) - (x - 1))).otherwise(rest), every, F.lit(None))
        return F.struct(g.alias("g"), at.cast("long").alias("at"), F.array_distinct(inside).alias("h"))

    laid = some.select("doc_id", "_row", F.explode(F.transform("_v", window)).alias("v")).select("doc_id", "_row", "v.*")
    known = template_table(spark, sets).select("g", "template", "th", F.explode(F.array_distinct(bands(minhashes(F.col("th"), n_bands * rows), n_bands, rows))).alias("band"))
    keyed = laid.withColumn("band", F.explode(F.array_distinct(bands(minhashes(F.col("h"), n_bands * rows), n_bands, rows))))
    found = keyed.join(F.broadcast(known), ["g", "band"]).withColumn("containment", F.size(F.array_intersect("h", "th")) / F.size("th")).where(F.col("containment") >= similar - 1e-9)
    best = F.max(F.struct("containment", (-F.col("at")).alias("at")))
    once = found.groupBy("_row", "doc_id", "template", "at").agg(F.max("containment").alias("containment"))
    return once.groupBy("_row", "doc_id", "template").agg(best.alias("b"), F.count("*").alias("windows")).select("doc_id", "template", F.col("b.containment").alias("containment"), (-F.col("b.at")).alias("first_word"), "windows")


def hashed(words: Column) -> Column:
    """Distinct shingle hashes of an array of words; fewer than SHINGLE words are one shingle."""
    by = lambda k: F.transform(F.slice(words, F.lit(1), F.size(words) - (k - 1)), shingle_at(words, k))
    short = reduce(lambda rest, k: F.when(F.size(words) == k, by(k)).otherwise(rest), range(1, SHINGLE), by(SHINGLE))
    return F.array_distinct(short)


def choices(spark: SparkSession, sets: list, similar: float) -> list[list[tuple[str, int]]]:
    """(first word, hash) of every group's chosen shingles, hashed as the texts are."""
    rows = [(g, s.split()) for g, (*_, group) in enumerate(sets) for s in sorted({s for _, ws in group for s in chosen(ws, similar)[0]})]
    found = spark.createDataFrame(rows, "g int, s array<string>").select("g", F.get("s", F.lit(0)).alias("a"), F.get(hashed(F.col("s")), F.lit(0)).alias("h")).collect()
    return [[(r["a"], r["h"]) for r in found if r["g"] == g] for g in range(len(sets))]


def template_table(spark: SparkSession, sets: list) -> DataFrame:
    rows = [(g, name, ws) for g, (_, _, group) in enumerate(sets) for name, ws in group]
    return spark.createDataFrame(rows, "g int, template string, ws array<string>").select("g", "template", hashed(F.col("ws")).alias("th"))
