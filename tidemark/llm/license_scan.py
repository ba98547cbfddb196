"""License scan with DataFrame functions only: MinHash sketches over overlapping windows, then exact containment.

A text is cut into windows of words that overlap by half, at sizes of a power of two. Each template is
looked for at the size that is at least twice its own length, so wherever it stands, it lies within one
window. The words are lower-cased runs of letters and digits; shingles are five words in a row.

Each window keeps only its shingles that occur in some template (a table of hashes, bounded by the templates).
A template's sketch is its bottom-k MinHash: the k shingles with the least hashes, k one more than the
shingles that a match may lack. So every match has a shingle of the sketch, whatever else is in the window,
and windows retrieve the templates whose sketch they share a shingle with; none is lost.

What a sketch retrieves is verified: the share of the template's distinct shingles that stand in the window must be
``CONTAINMENT`` or more. Templates shorter than a shingle can't be scanned for.

Texts that can't match are passed over early without a loss: a template's match needs 0.8 of its
shingles, so it needs one of its *anchors*, words chosen such that their shingles are more than 0.2 of
the template's. Only texts with some anchor are cut into windows.

The texts are read once: what matches is written to the shared folder (few rows), and overlapping windows are
merged there.

A null or short text has no match. Matches are reported once for each row, template and place (of a run
of overlapping windows the first); repeated rows are reported each. An empty table gives no rows.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SHINGLE = 5
CONTAINMENT = 0.8
#: Smallest window, in words.
SMALLEST = 16

#: License statements in public use, as their publishers give them.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT-line-2": "This project is licensed under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Words are runs of letters and digits; a version number's dots split it.
BETWEEN = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def shingles_of(words: list[str]) -> list[int]:
    """Distinct signed XXH64 (seed 42) of the shingles, as Spark's ``xxhash64`` gives them."""
    found = {xxhash.xxh64_intdigest(" ".join(words[k : k + SHINGLE]).encode(), 42) for k in range(len(words) - SHINGLE + 1)}
    return sorted(h - (1 << 64) if h >> 63 else h for h in found)


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which every sufficient match of any template holds one: greedily, the rarest over templates first."""
    split = {name: template_words(text) for name, text in templates.items()}
    spread = {w: sum(w in own for own in split.values()) for words in split.values() for w in words}
    chosen: set[str] = set()
    for words in split.values():
        sets = [words[k : k + SHINGLE] for k in range(len(words) - SHINGLE + 1)]
        distinct = {tuple(s) for s in sets}

        def covered(distinct=distinct) -> float:
            return sum(any(w in chosen for w in s) for s in distinct) / max(1, len(distinct))

        candidates = sorted(set(words), key=lambda w: (-len(w), spread[w], w))
        for w in candidates:
            if covered() > 1 - CONTAINMENT + 1e-9:
                break
            chosen.add(w)
    return sorted(chosen)


def window_size(words: int) -> int:
    size = SMALLEST
    while size < 2 * words:
        size *= 2
    return size


def template_table(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """license, size (of windows), shingles (hashes) of each template. A template shorter than a shingle can't be told from prose and is an error."""
    if short := sorted(name for name, text in templates.items() if len(template_words(text)) < SHINGLE):
        raise ValueError(f"templates of fewer than {SHINGLE} words: {', '.join(short)}")
    rows = [(name, window_size(len(words)), shingles_of(words)) for name, text in sorted(templates.items()) for words in [template_words(text)]]
    return docs.sparkSession.createDataFrame(rows, "license string, size int, template array<long>")


def sketch(shingles: list[int]) -> list[int]:
    """The shingles with the least hashes (XXH64 of their own), so many that a match has one of them."""
    lacking = int((1 - CONTAINMENT) * len(shingles) + 1e-9)
    return sorted(shingles, key=lambda h: (xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True)), h))[: lacking + 1]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def windows(docs: DataFrame, sizes: list[int], known: list[int], wanted: list[str]) -> DataFrame:
    """row, doc_id, size, from_word, own (its distinct shingles that occur in templates) of windows with any."""
    text = F.col("text").cast("string")
    pattern = "(?<![\\p{L}\\p{N}])(?:" + "|".join(map(re.escape, wanted)) + ")(?![\\p{L}\\p{N}])"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")).where(F.lower("text").rlike(pattern))
    words = rows.select("row", "doc_id", words_of(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE)
    last = F.size("w") - SHINGLE
    hashed = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("at"), F.xxhash64(F.array_join(F.slice("w", k + 1, SHINGLE), " ")).alias("h")))
    hits = F.filter(hashed, lambda s: s["h"].isin(known))
    hit = words.select("row", "doc_id", F.explode(hits).alias("s")).select("row", "doc_id", F.col("s.at").alias("at"), F.col("s.h").alias("h"))
    # A shingle is in the windows that begin half a size apart and hold all of its words.
    each = hit.withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes))))
    half = F.col("size") / 2
    place = F.explode(F.array(F.floor(F.col("at") / half), F.floor(F.col("at") / half) - 1)).alias("window")
    placed = each.select("*", place).where((F.col("window") >= 0) & (F.col("at") + SHINGLE <= F.col("window") * half + F.col("size")))
    return placed.groupBy("row", "doc_id", "size", "window").agg(F.collect_set("h").alias("own"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment, from_word, to_word: a row for each place of a license."""
    table = template_table(docs, templates)
    known = table.collect()
    sizes, hashes = sorted({r["size"] for r in known}), sorted({h for r in known for h in r["template"]})
    found = windows(docs, sizes, hashes, anchors(templates))
    rows = [(r["license"], r["size"], r["template"], h) for r in known for h in sketch(r["template"])]
    sketches = docs.sparkSession.createDataFrame(rows, "license string, size int, template array<long>, h long")
    kept = F.filter("own", lambda h: h.isin(sorted({r[3] for r in rows})))
    shared = found.select("*", F.explode(kept).alias("h"))
    share = F.size(F.array_intersect("own", "template")) / F.size("template")
    pairs = stored(shared.join(F.broadcast(sketches), ["size", "h"]).select("row", "doc_id", "size", "window", "license", share.alias("containment")).where(F.col("containment") >= CONTAINMENT).distinct())
    first = pairs.alias("a").join(pairs.select("row", "license", (F.col("window") + 1).alias("window")).alias("b"), ["row", "license", "window"], "left_anti")
    start = (F.col("window") * F.col("size") / 2).cast("long")
    return first.select("doc_id", "license", "containment", start.alias("from_word"), (start + F.col("size")).alias("to_word"))


def oracle_sql(templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL for ``scan_licenses`` by brute force: every shingle of every text against every template's."""
    kept = {name: words for name, text in templates.items() if len(words := template_words(text)) >= SHINGLE}
    rows = sorted({(name, window_size(len(w)), " ".join(w[k : k + SHINGLE])) for name, w in kept.items() for k in range(len(w) - SHINGLE + 1)})
    values = ", ".join(f"('{name}', {size}, '{s}')" for name, size, s in rows)
    return f"""
WITH template(license, size, shingle) AS (VALUES {values}),
total AS (SELECT license, count(*) AS n FROM template GROUP BY license),
split AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
shingle AS (SELECT doc_id, unnest(range(len(w) - {SHINGLE - 1})) AS pos, unnest(list_transform(range(len(w) - {SHINGLE - 1}), lambda k: array_to_string(w[k + 1:k + {SHINGLE}], ' '))) AS shingle FROM split WHERE len(w) >= {SHINGLE}),
hit AS (SELECT doc_id, pos, license, size, shingle FROM shingle JOIN template USING (shingle)),
placed AS (SELECT *, unnest([pos // (size // 2), pos // (size // 2) - 1]) AS w FROM hit),
share AS (SELECT doc_id, license, size, w, count(DISTINCT shingle) / any_value(n) AS containment FROM placed JOIN total USING (license)
    WHERE w >= 0 AND pos + {SHINGLE} <= w * (size // 2) + size GROUP BY ALL HAVING count(DISTINCT shingle) / any_value(n) >= {CONTAINMENT})
SELECT doc_id, license, containment, CAST(w * (size // 2) AS BIGINT) AS from_word, CAST(w * (size // 2) + size AS BIGINT) AS to_word FROM share a
WHERE NOT EXISTS (SELECT 1 FROM share b WHERE b.doc_id = a.doc_id AND b.license = a.license AND b.w + 1 = a.w)
"""
