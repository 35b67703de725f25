"""Licence detection: normalised text against templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import pkgutil
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import col

THRESHOLD = 0.8

#: (licence, template text).
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is released under the Apache License 2.0."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "No part of this publication may be reproduced without the prior written permission of the publisher."),
]

_GNU = [("GPL-1.0", "GNU General Public License", "1"), ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.0", "GNU Library General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3")]
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _variants() -> list[tuple[str, str]]:
    """Notices of every version and variant of the GNU and Creative Commons licences, each for works, programs and libraries."""
    out = []
    for name, title, version in _GNU:
        for what in ("work", "program", "library", "software", "file", "project"):
            out.append((name, f"This {what} is licensed under the {title}, version {version}."))
            free = f"This {what} is free software{{}} you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation{{}} version {version} of the License"
            out.append((name, free.format(":", ", either") + ", or (at your option) any later version."))
            out.append((name, free.format(";", ",") + "."))
        short = name.split("-")[0]
        out += [(name, f"Licensed under the {title}, version {version}."), (name, f"Licensed under the {title} v{version}."), (name, f"Licensed under {short} version {version}.")]
    for kind, title in _CC.items():
        for version, place in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            name, title_ = f"CC-{kind}-{version}", title.replace("NoDerivatives", "NoDerivs") if version < "4" else title
            out.append((name, f"Licensed under CC {kind} {version}."))
            out.append((name, f"This work is licensed under a Creative Commons {title_} {version} {place} License."))
            out.append((name, f"This work is licensed under the Creative Commons {title_} {version} {place} License."))
            out.append((name, f"Licensed under the Creative Commons {title_} {version} {place} License."))
    return out


TEMPLATES += [x for x in _variants() if x not in TEMPLATES]


_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Whole texts as files of the package, by licence.
_FILES = {"GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic-1.0": "Artistic", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "BSD-3-Clause": "BSD"}


def _whole() -> list[tuple[str, str]]:
    """Whole licences: the short ones, and those in files."""
    by = {name: text for name, text in reversed(TEMPLATES) if name in ("MIT", "ISC") and len(text) > 150}
    out = [
        ("MIT", by["MIT"] + " " + _MIT_END),
        ("ISC", by["ISC"] + " " + _ISC_END),
        ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
        ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"),
        ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
        ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
        ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ]
    return out + [(name, pkgutil.get_data(__package__, f"licences/{file}.txt").decode("utf-8", "replace")) for name, file in _FILES.items()]


TEMPLATES += _whole()

#: Whatever is neither an ASCII letter or digit nor beyond ASCII ends a word.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_MAP_BITS = 20
SCHEMA = "doc_id long, unit string, first_line long, last_line long, license string, template int, dice double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("unit", pa.string()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("dice", pa.float64())])


def _pairs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, row) of each word, and a hash of each word with the next."""
    start, end, row = tb.words(data, offs, _BREAK)
    h = tb.span_hash(tb.prefix(data), start, end)
    return start, row, tb.mix(h[:-1] * tb.U64(31) + h[1:]) if len(h) else h


def anchor_places(size: int) -> list[int]:
    """Which of a template's pairs windows are laid by."""
    return sorted({0, size // 2, size - 1})


class Matcher:
    """Templates as multisets of bigrams, by size, with a bitmap of all their bigrams."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold, self.least = threshold, threshold / (2 - threshold)
        self.templates = []
        self.bitmap = np.zeros(1 << _MAP_BITS, bool)
        for i, (name, text) in enumerate(templates):
            _, _, pairs = _pairs(*tb.buffers(pa.array([text], pa.large_string())))
            if len(pairs):
                self.bitmap[pairs >> tb.U64(64 - _MAP_BITS)] = True
                self.templates.append((len(pairs), name, i, Counter(pairs.tolist())))
        #: Where windows begin: by the first, middle and last pair of a template, its number and the pair's place in it.
        self.anchors: dict[int, list[tuple[int, int]]] = {}
        self.anchored = np.zeros(1 << _MAP_BITS, bool)
        for k, (size, _, i, _) in enumerate(self.templates):
            _, _, pairs = _pairs(*tb.buffers(pa.array([templates[i][1]], pa.large_string())))
            for at in anchor_places(size):
                self.anchors.setdefault(int(pairs[at]), []).append((k, at))
                self.anchored[pairs[at] >> tb.U64(64 - _MAP_BITS)] = True
        sizes = [t[0] for t in self.templates] or [1]
        self.smallest, self.largest = min(sizes) * self.least, max(sizes) / self.least

    def best(self, pairs: np.ndarray) -> tuple[float, str, int] | None:
        """Of the templates of a size that can reach the threshold, the best; of those that tie, the first listed."""
        n, own, found = len(pairs), None, None
        for size, name, i, bag in self.templates:
            if self.least * n - 1e-9 <= size <= n / self.least + 1e-9:
                own = own or Counter(pairs.tolist())
                dice = 2 * sum(min(k, bag[x]) for x, k in own.items() if x in bag) / (n + size)
                if dice >= self.threshold and (found is None or dice > found[0]):
                    found = (dice, name, i)
        return found

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, str, int, int, float, str, int]]:
        data, offs = tb.buffers(texts)
        start, row, pairs = _pairs(data, offs)
        if not len(pairs):
            return
        newline = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 10, out=newline[1:])
        line = newline[start] - newline[offs[row]]
        hit = np.zeros(len(start) + 1, np.int64)
        np.cumsum(self.bitmap[pairs >> tb.U64(64 - _MAP_BITS)], out=hit[1:-1])
        hit[-1] = hit[-2]
        other = row[1:] != row[:-1]
        lines = np.concatenate([[0], np.flatnonzero(other | (line[1:] != line[:-1])) + 1, [len(start)]])
        blocks = np.concatenate([[0], np.flatnonzero(other | (line[1:] > line[:-1] + 1)) + 1, [len(start)]])
        whole = np.concatenate([[0], np.flatnonzero(other) + 1, [len(start)]])
        taken: set[tuple[int, int, int]] = set()
        for unit, cuts, parts in (("line", lines, None), ("block", blocks, lines), ("document", whole, blocks)):
            a, b = cuts[:-1], cuts[1:]
            n = b - a - 1
            ok = (n >= max(1, self.smallest - 1e-9)) & (n <= self.largest + 1e-9) & (hit[b - 1] - hit[a] >= self.least * n - 1e-9)
            if parts is not None:  # a unit of one part is that part
                ok &= np.searchsorted(parts, b) - np.searchsorted(parts, a) > 1
            for k in np.flatnonzero(ok):
                if m := self.best(pairs[a[k] : b[k] - 1]):
                    taken.add((int(row[a[k]]), int(line[a[k]]), int(line[b[k] - 1])))
                    yield int(row[a[k]]), unit, int(line[a[k]]), int(line[b[k] - 1]), *m
        for (r, a, b), (dice, i, name) in self.windows(row, line, pairs, hit, whole).items():
            if (r, a, b) not in taken:
                yield r, "window", a, b, -dice, name, i

    def windows(self, row: np.ndarray, line: np.ndarray, pairs: np.ndarray, hit: np.ndarray, whole: np.ndarray) -> dict[tuple[int, int, int], tuple[float, int, str]]:
        """(row, first line, last line) of windows as long as a template around one of its anchors: the best (-dice, template, licence)."""
        found: dict[tuple[int, int, int], tuple[float, int, str]] = {}
        done: set[tuple[int, int, int]] = set()
        same = np.append(row[1:] == row[:-1], False)[: len(pairs)]
        for p in np.flatnonzero(self.anchored[pairs >> tb.U64(64 - _MAP_BITS)] & same):
            for k, at in self.anchors.get(int(pairs[p]), ()):
                size, name, i, bag = self.templates[k]
                w = np.searchsorted(whole, p, "right")
                a, b = max(int(whole[w - 1]), int(p) - at), min(int(whole[w]), int(p) - at + size + 1)
                n = b - a - 1
                if hit[b - 1] - hit[a] < self.threshold * (n + size) / 2 - 1e-9 or (k, a, b) in done:
                    continue
                done.add((k, a, b))
                dice = 2 * sum(min(x, bag[y]) for y, x in Counter(pairs[a : b - 1].tolist()).items() if y in bag) / (n + size)
                place = int(row[a]), int(line[a]), int(line[b - 1])
                if dice >= self.threshold and (place not in found or (-dice, i) < found[place][:2]):
                    found[place] = (-dice, i, name)
        sizes = {i: size for size, _, i, _ in self.templates}
        beaten, open_ = set(), []
        for r, a, b in sorted(found):
            open_ = [x for x in open_ if x[0] == r and x[2] >= a]
            for x in open_:
                for place, other in ((x, (r, a, b)), ((r, a, b), x)):
                    if found[other][:2] < found[place][:2] and 2 * sizes[found[other][1]] >= sizes[found[place][1]]:
                        beaten.add(place)
            open_.append((r, a, b))
        return {k: v for k, v in found.items() if k not in beaten}


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, templates: list[tuple[str, str]], threshold: float) -> Matcher:
    """The matcher of a plan, built once in each worker process."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(templates, threshold)
    return _MATCHERS[key]


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, first_line, last_line, license, template, dice) of every part of a text that a template matches.

    The parts are each line, each block (consecutive lines that hold words, if more than one), the document (if it has
    several blocks), and windows: wherever the first, middle or last pair of a template's words occurs, as many words as the template has
    around it, whatever stands before and after.  Of windows over the same lines the best is given, of those that overlap none that is worse than
    another whose template is at least half as long, and none where another part of just these lines matches.  Text is lower-cased; words are runs of letters and digits, and of anything beyond ASCII.  Dice =
    2 |A and B| / (|A| + |B|) over multisets of word bigrams.  It can reach t only where t/(2-t) <= |A|/|B| <= (2-t)/t, so only
    templates of such sizes are compared, and only parts of which at least t/(2-t) of the bigrams occur in some template.

    Edge cases: null, empty and one-word texts match nothing.  Of templates that tie the first listed is given.  Rows with null or
    repeated ids are scanned like any other.  Texts are read whole, however long.  No templates or no rows: no rows.  Lines are numbered from 0.
    Other columns aren't read.
    """

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, templates, threshold)
        for batch in batches:
            ids, found = batch.column(0), []
            for first, part in tb.chunks(batch.column(1), 1 << 20):
                found += [(first + r, *x) for r, *x in matcher.scan(part)]
            found.sort()
            at, unit, a, b, dice, name, i = zip(*found) if found else ([],) * 7
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(x, f.type) for x, f in zip((unit, a, b, name, i, dice), list(_ARROW)[1:]))], schema=_ARROW)

    return docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text")).where(F.col("text") != "").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence found in the documents."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql(templates: list[tuple[str, str]], threshold: float) -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(templates))
    words = r"list_filter(string_split(regexp_replace(lower({}), '[\x00-/:-`{{-\x7f]+', ' ', 'g'), ' '), lambda x: x <> '')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH t AS (SELECT i, license, {words.format("body")} AS w FROM (VALUES {values}) v(i, license, body)),
tb AS (SELECT i, license, len(w) - 1 AS size, unnest({pairs}) AS pair FROM t),
tc AS (SELECT i, license, size, pair, count(*) AS k FROM tb GROUP BY ALL),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
line AS (SELECT doc_id, pos, {words.format("line")} AS w FROM raw),
filled AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM line WHERE len(w) > 0),
unit AS (
  SELECT doc_id, 'line' AS unit, pos AS first_line, pos AS last_line, w FROM filled
  UNION ALL SELECT doc_id, 'block', min(pos), max(pos), flatten(list(w ORDER BY pos)) FROM filled GROUP BY doc_id, block HAVING count(*) > 1
  UNION ALL SELECT doc_id, 'document', min(pos), max(pos), flatten(list(w ORDER BY pos)) FROM filled GROUP BY doc_id HAVING count(DISTINCT block) > 1),
ub AS (SELECT doc_id, unit, first_line, last_line, len(w) - 1 AS n, unnest({pairs}) AS pair FROM unit),
uc AS (SELECT doc_id, unit, first_line, last_line, n, pair, count(*) AS k FROM ub GROUP BY ALL),
d AS (
  SELECT doc_id, unit, first_line, last_line, license, i, 2 * sum(least(uc.k, tc.k))::DOUBLE / (any_value(n) + any_value(size)) AS dice
  FROM uc JOIN tc ON uc.pair = tc.pair GROUP BY doc_id, unit, first_line, last_line, license, i),
best AS (SELECT * FROM d WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, unit, first_line ORDER BY dice DESC, i) = 1),
anchor AS (
  SELECT DISTINCT i, len(w) AS words, off, w[off + 1] || ' ' || w[off + 2] AS pair
  FROM (SELECT i, w, unnest([0, (len(w) - 1) // 2, len(w) - 2]) AS off FROM t WHERE len(w) > 1)),
text AS (SELECT doc_id, flatten(list(w ORDER BY pos)) AS w, flatten(list(list_transform(w, lambda x: pos) ORDER BY pos)) AS at_line FROM filled GROUP BY doc_id),
place AS (SELECT doc_id, unnest(range(1, len(w))) AS p, unnest({pairs}) AS pair FROM text),
laid AS (SELECT DISTINCT doc_id, i, words, p - off AS lo, p - off + words - 1 AS hi FROM place JOIN anchor USING (pair)),
win AS (
  SELECT row_number() OVER () AS k, doc_id, i, at_line[greatest(lo, 1)] AS first_line, at_line[least(hi, len(text.w))] AS last_line, text.w[greatest(lo, 1):least(hi, len(text.w))] AS w
  FROM laid JOIN text USING (doc_id)),
wb AS (SELECT k, i, len(w) - 1 AS n, unnest({pairs}) AS pair FROM win),
wc AS (SELECT k, i, n, pair, count(*) AS many FROM wb GROUP BY ALL),
wd AS (
  SELECT wc.k, 2 * sum(least(wc.many, tc.k))::DOUBLE / (any_value(n) + any_value(size)) AS dice
  FROM wc JOIN tc ON wc.i = tc.i AND wc.pair = tc.pair GROUP BY wc.k),
wbest AS (
  SELECT doc_id, 'window' AS unit, first_line, last_line, license, win.i, dice, len(t.w) - 1 AS size
  FROM wd JOIN win USING (k) JOIN t ON t.i = win.i WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, first_line, last_line ORDER BY dice DESC, win.i) = 1),
alone AS (
  SELECT doc_id, unit, first_line, last_line, license, i, dice FROM wbest x WHERE NOT EXISTS (
    FROM wbest y WHERE y.doc_id = x.doc_id AND y.first_line <= x.last_line AND y.last_line >= x.first_line AND (y.dice > x.dice OR (y.dice = x.dice AND y.i < x.i)) AND 2 * y.size >= x.size))
SELECT doc_id, unit, first_line::BIGINT AS first_line, last_line::BIGINT AS last_line, license, i::INTEGER AS template, dice
FROM (SELECT * FROM best UNION ALL SELECT * FROM alone ANTI JOIN best USING (doc_id, first_line, last_line))
"""


SQL = _sql(TEMPLATES, THRESHOLD)
