"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

DataFrame functions only. Templates are a small fixed list; the documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of licenses with the notices that give them away (public license texts' own words).
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
        "but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public "
        "domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
        "rights to this software under copyright law.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General "
        "Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the CC0 1.0 Universal Public Domain Dedication."),
]
#: Words in a shingle, least share of a template's shingles in one window, and the chance that a window holding just that share is missed.
WIDTH, CONTAINMENT, MISS = 5, 0.8, 1e-5
#: Shingles from which a template's bands have two rows; letters from which a word is a test for a text.
TWO_ROWS, LONG_WORD = 12, 6


@dataclass(frozen=True)
class Template:
    number: int
    name: str
    width: int
    shingles: tuple[str, ...]
    pivots: tuple[str, ...] = ()  # shingles of which every match holds at least one: it misses at most all but `needed`

    @property
    def needed(self) -> int:
        return math.ceil(CONTAINMENT * len(self.shingles))


@dataclass(frozen=True)
class Geometry:
    """Windows for templates of like size: `window` shingles every `stride`, so that some window holds any whole occurrence."""

    width: int
    stride: int
    window: int
    bands: int
    rows: int
    templates: tuple[Template, ...]


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def compile_templates(templates: list[tuple[str, str]]) -> list[Geometry]:
    """Group templates by shingle width and count and set each group's windows and bands.

    A window that holds the needed share of a template's shingles has Jaccard similarity j or more with it; with r rows in a band,
    the number of bands makes 1 - (1 - j ** r) ** bands at least 1 - MISS. Small templates have one row, as chance matches are few in small windows.
    Templates without words are left out.
    """
    made = []
    for number, (name, text) in enumerate(templates):
        words = words_of(text)
        if words:
            width = min(WIDTH, len(words))
            made.append(Template(number, name, width, tuple(dict.fromkeys(" ".join(words[i : i + width]) for i in range(len(words) - width + 1)))))
    # any so many shingles will do as pivots: those that hold a few telling words
    chosen: list[str] = []
    for k in sorted(range(len(made)), key=lambda k: (len(made[k].shingles), k)):
        t = made[k]
        made[k] = replace(t, pivots=tuple(_cover(list(t.shingles), len(t.shingles) - t.needed + 1, chosen)))
    groups: list[list[Template]] = []
    for t in sorted(made, key=lambda t: (t.width, len(t.shingles))):
        if groups and groups[-1][0].width == t.width and len(t.shingles) <= 1.5 * len(groups[-1][0].shingles):
            groups[-1].append(t)
        else:
            groups.append([t])
    out = []
    for g in groups:
        low, high = len(g[0].shingles), len(g[-1].shingles)
        stride = max(1, low // 4)
        window = high + stride - 1
        j = min(t.needed / (window + len(t.shingles) - t.needed) for t in g)
        rows = 2 if low >= TWO_ROWS else 1
        bands = 1 if j >= 1 else math.ceil(math.log(MISS) / math.log(1 - j**rows))
        out.append(Geometry(g[0].width, stride, window, bands, rows, tuple(g)))
    return out


def _array(values: list[Column]) -> Column:
    return F.array(*values)


def _shingles(words: Column, width: int) -> Column:
    n = F.size(words) - width
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, width), " "))).otherwise(F.array().cast("array<string>"))


def _minima(hashes: Column, count: int) -> Column:
    """Minima of `count` hash functions over hashed shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def _banded(minima: Column, g: Geometry) -> Column:
    """One value for each band of a signature."""
    first = F.slice(minima, 1, g.bands)
    return first if g.rows == 1 else F.zip_with(first, F.slice(minima, g.bands + 1, g.bands), lambda x, y: F.xxhash64(x, y))


def _signature(t: Template, g: Geometry) -> Column:
    hashes = F.transform(_array([F.lit(x) for x in t.shingles]), lambda x: F.xxhash64(x))
    return _bound(_minima(hashes, g.bands * g.rows), lambda m: _banded(m, g))


def _near(shingles: Column, hashes: Column, number: int, g: Geometry, known: Column) -> Column:
    """Windows (geometry, at, sig: each band's value, part: its shingles) that share a band's value with a template."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(g.bands * g.rows - 1)), lambda k: F.transform(hashes, lambda h: F.xxhash64(h, k)))

    def signed(rows: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(g.stride))
        minima = lambda i: F.transform(rows, lambda h: F.array_min(F.slice(h, i + 1, g.window)))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), _bound(minima(i), lambda m: _banded(m, g)).alias("sig")))

    kept = F.filter(_bound(rows, signed), lambda w: F.arrays_overlap(w["sig"], known))
    found = F.transform(kept, lambda w: F.struct(F.lit(number).alias("geometry"), w["at"].alias("at"), w["sig"].alias("sig"), F.slice(shingles, w["at"] + 1, g.window).alias("part")))
    return F.when(F.size(hashes) > 0, found)


def _cover(parts: list[str], least: int, chosen: list[str]) -> list[str]:
    """Of the parts, the first `least` that hold a chosen word; words (long ones where there are any) are added to chosen, those in most parts first, until there are so many."""
    while True:
        held = [p for p in parts if any(w in p for w in chosen)]
        if len(held) >= least:
            return held[:least]
        counts: dict[str, int] = {}
        for p in parts:
            if p not in held:
                for w in {w for w in p.split() if len(w) >= LONG_WORD} or {max(p.split(), key=lambda w: (len(w), w))}:
                    counts[w] = counts.get(w, 0) + 1
        chosen.append(max(counts, key=lambda w: (counts[w], w)))


def key_words(geometries: list[Geometry]) -> list[str]:
    """A few words of which every pivot holds one."""
    chosen: list[str] = []
    pivots = [p for g in geometries for t in g.templates for p in t.pivots]
    _cover(pivots, len(pivots), chosen)
    return sorted(chosen)


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once: a one-element transform binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License notices in whole texts: one row for each id and template found: (id_col, template int, license, containment double, first_word int).

    Texts are read as their words [a-z0-9]+ after lowering. template counts the given list; containment is the largest share of its
    shingles (WIDTH words; a shorter template is one shingle) in any window, at least CONTAINMENT; first_word is the
    number (from 0) of the first word of the first such window's first shared shingle. Null and empty texts hold nothing; repeated rows
    of an id count as one, also under a null id; only the named columns are read; empty tables or templates give no rows.

    Texts without any template's pivots are set aside first: by the pigeonhole principle no window of theirs could verify.
    """
    geometries = compile_templates(templates)
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    result = f"`{id_col}` {id_type}, template int, license string, containment double, first_word int"
    if not geometries:
        return spark.createDataFrame([], result)
    any_of = lambda text, parts: F.exists(_array([F.lit(p) for p in parts]), lambda p: F.contains(text, p))
    # cheap and lossless first: a text without any of these words holds no pivot; lowered once for all of them
    base = docs.where(_bound(F.lower(F.col(text_col)), lambda t: any_of(t, key_words(geometries))))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.col(text_col)), "[^a-z0-9]+", " ")), F.lit(" "))
    # one flag for each geometry: does the text hold a pivot of its templates
    flags = lambda t: _array([any_of(t, [f" {p} " for x in g.templates for p in x.pivots]) for g in geometries])
    tested = _bound(norm, lambda t: F.struct(t.alias("norm"), flags(t).alias("flags")))
    base = base.select(F.col(id_col).alias("id"), tested.alias("x")).select("id", "x.*").where(F.array_contains("flags", True))
    base = base.select("id", "flags", F.split(F.trim("norm"), " ").alias("words"))
    # shingles and their hashes once for each width, then the windows of every geometry
    widths = sorted({g.width for g in geometries})
    base = base.select("id", "flags", *(_shingles(F.col("words"), w).alias(f"s{w}") for w in widths))
    base = base.select("*", *(F.transform(f"s{w}", lambda x: F.xxhash64(x)).alias(f"h{w}") for w in widths))
    sample = [_signature(t, g).alias(str(t.number)) for g in geometries for t in g.templates]
    wanted = spark.range(1).select(*sample).first()
    bands = [(t.number, n, k, wanted[str(t.number)][k]) for n, g in enumerate(geometries) for t in g.templates for k in range(g.bands)]
    near = []
    for n, g in enumerate(geometries):
        known = _array([F.lit(v) for v in sorted({v for _, m, _, v in bands if m == n})])
        near.append(F.when(F.col("flags")[n], _near(F.col(f"s{g.width}"), F.col(f"h{g.width}"), n, g, known)))
    none = F.array().cast("array<struct<geometry:int,at:int,sig:array<bigint>,part:array<string>>>")
    found = base.select("id", F.explode(F.flatten(_array([F.coalesce(x, none) for x in near]))).alias("w"))
    found = found.select("id", "w.geometry", "w.at", "w.part", F.posexplode("w.sig").alias("band", "value"))
    table = spark.range(1).select(F.inline(_array([F.struct(F.lit(t).alias("template"), F.lit(n).alias("geometry"), F.lit(k).alias("band"), F.lit(v).alias("value")) for t, n, k, v in bands])))
    every = found.join(F.broadcast(table), ["geometry", "band", "value"]).select("id", "at", "part", "template")
    texts = F.create_map(*[x for g in geometries for t in g.templates for x in (F.lit(t.number), _array([F.lit(s) for s in t.shingles]))])
    names = F.create_map(*[x for g in geometries for t in g.templates for x in (F.lit(t.number), F.lit(t.name))])
    every = every.withColumn("want", texts[F.col("template")])
    every = every.withColumn("containment", F.size(F.array_intersect("want", "part")) / F.size("want")).where(F.col("containment") >= CONTAINMENT)
    first = F.col("at") + F.array_position(F.transform("part", lambda x: F.array_contains(F.col("want"), x)), True).cast("int") - 1
    best = every.groupBy("id", "template").agg(F.max(F.struct("containment", (-first).alias("first"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "template", names[F.col("template")].alias("license"), F.col("b.containment").alias("containment"), (-F.col("b.first")).cast("int").alias("first_word"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """DuckDB SQL for scan() over documents: every grid window's containment, without MinHash."""
    values = [f"({t.number}, '{t.name}', {t.width}, {g.stride}, {g.window}, {len(t.shingles)}, '{s}')" for g in compile_templates(templates) for t in g.templates for s in t.shingles]
    widths = sorted({g.width for g in compile_templates(templates)})
    parts = "\n  UNION ALL ".join(f"SELECT doc_id, {w} AS width, i AS p, array_to_string(words[i + 1 : i + {w}], ' ') AS s FROM w, unnest(range(0, len(words) - {w} + 1)) AS r(i)" for w in widths)
    return f"""
WITH t(template, license, width, stride, win, n, s) AS (VALUES {', '.join(values)}),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents WHERE text IS NOT NULL),
g AS (
  {parts}
),
h AS (SELECT doc_id, template, license, n, stride, win, p, t.s FROM g JOIN t ON g.s = t.s AND g.width = t.width),
c AS (
  SELECT doc_id, template, license, k * stride AS at, count(DISTINCT s) / n AS containment, min(p) AS first_word
  FROM h, unnest(range(greatest(0, (p - win + stride) // stride), p // stride + 1)) AS r(k)
  GROUP BY doc_id, template, license, n, k, stride
),
b AS (SELECT doc_id, template, license, containment, first_word, row_number() OVER (PARTITION BY doc_id, template ORDER BY containment DESC, first_word) AS r FROM c WHERE containment >= {CONTAINMENT})
SELECT doc_id, CAST(template AS INTEGER) AS template, license, CAST(containment AS DOUBLE) AS containment, CAST(first_word AS INTEGER) AS first_word FROM b WHERE r = 1
"""
