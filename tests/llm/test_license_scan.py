from collections import Counter

from textloom.llm.license_scan import TEMPLATES, license_scan


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def dice(a, b):
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


BAGS = [words(t) for _, t in TEMPLATES]


def brute(text):
    lines = [words(x) for x in text.split("\n")]
    units, blocks, now = [], [], []
    for i, w in enumerate([*lines, []]):
        if w:
            units.append(("line", i, i, w))
            now.append(i)
        elif now:
            blocks.append(now)
            now = []
    units += [("block", b[0], b[-1], sum((lines[i] for i in b), [])) for b in blocks if len(b) > 1]
    if len(blocks) > 1:
        units.append(("document", blocks[0][0], blocks[-1][-1], sum(lines, [])))
    out = []
    for unit, a, b, w in units:
        best = max(((dice(w, t), -i) for i, t in enumerate(BAGS)), default=(0, 0))
        if best[0] >= 0.8:
            out.append((unit, a, b, TEMPLATES[-best[1]][0], -best[1], round(best[0], 9)))
    taken, flat, windows = {x[1:3] for x in out}, [(w, k) for k, its in enumerate(lines) for w in its], {}
    own = [w for w, _ in flat]
    for i, t in enumerate(BAGS):
        for at in {0, (len(t) - 1) // 2, len(t) - 2}:
            for p in range(len(own) - 1):
                if own[p : p + 2] == t[at : at + 2]:
                    a, b = max(0, p - at), min(len(own), p - at + len(t))
                    place, found = (flat[a][1], flat[b - 1][1]), (-dice(own[a:b], t), i)
                    if found[0] <= -0.8:
                        windows[place] = min(windows.get(place, found), found)
    meet = lambda x, y: x[0] <= y[1] and y[0] <= x[1]
    size = lambda v: len(BAGS[v[1]]) - 1
    windows = {x: v for x, v in windows.items() if not any(meet(x, y) and u < v and 2 * size(u) >= size(v) for y, u in windows.items()) and x not in taken}
    out += [("window", *place, TEMPLATES[i][0], i, round(-d, 9)) for place, (d, i) in windows.items()]
    return sorted(out)


def test_against_brute_force(spark):
    mit = TEMPLATES[3][1]
    texts = [
        "Intro.\nReleased under the MIT License.\nmore",
        "Été: Licensed under the Apache  License (Version 2.0)!",
        "/* " + mit.replace(", ", ",\n * ") + " */",
        mit[:300] + "\n\n" + mit[300:],
        "Licensed under CC BY-SA 4.0.\n\nLicensed under CC BY-NC 4.0.\nAll rights reserved",
        "all rights", "word", "", "\n\n", "of the the of the of the " * 2000,
        "This work is licensed under the GNU General Public License version 3",
        "int main() {}\n// " + mit + " int x = 3;\nreturn x;\n" + mit[:200] + "\nend",
        "Licensed under CC BY 4.0. All rights reserved. Licensed under CC BY 4.0. And so on",
    ]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)] + [(None, None, 1.0), (None, texts[0], 1.0)], "doc_id long, text string, dice double")
    rows = license_scan(df).collect()
    got = {i: sorted((r["unit"], r["first_line"], r["last_line"], r["license"], r["template"], round(r["dice"], 9)) for r in rows if r["doc_id"] == i) for i in [*range(len(texts)), None]}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t
    assert got[None] == got[0] and len(got[2]) >= 1


def test_no_templates_and_no_rows(spark):
    df = spark.createDataFrame([(1, "All rights reserved.")], "doc_id long, text string")
    assert license_scan(df, templates=[]).collect() == []
    assert license_scan(df.limit(0)).collect() == []


def test_versions_and_variants_that_are_no_templates(spark):
    gnu = "{} is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    want = [("GPL-2.0", "This module is licensed under the GNU General Public License, version 2.")]
    for name, kind, version in (("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3")):
        want += [(name, gnu.format(who, kind, version)) for who in ("This script", "Foo", "The library")]
        want.append((name, f"// This tool is licensed under the GNU {kind} Public License, version {version}"))
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        want += [(f"CC-{kind}-{v}", f"It is licensed under CC {kind} {v}.") for v in ("2.0", "3.0", "4.0")]
    assert not {t for _, t in want} & {t for _, t in TEMPLATES}
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(want)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan(df).collect()}
    assert [got.get(i) for i in range(len(want))] == [name for name, _ in want]


def test_whole_licences_and_notices_within_longer_parts(spark):
    whole = {name: text for name, text in TEMPLATES if len(text) > 600}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(whole)
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY.\ndef f(x):\n    return x"
    want = [(name, f"Copyright 2020 Somebody\n{text}\nprint('code follows at once')") for name, text in whole.items()]
    want += [("MIT", "Copyright (c) 2020 Somebody Else " + whole["MIT"].replace("\n", " ")), ("GPL-3.0", gpl), ("Apache-2.0", "# Licensed under the Apache License, Version 2.0 (the 'License'); you may not use it otherwise\n# than it says.\nimport os")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(want)], "doc_id long, text string")
    best = {}
    for r in license_scan(df).collect():
        best[r["doc_id"]] = max(best.get(r["doc_id"], (0, 0, "")), (round(r["dice"], 1), r["last_line"] - r["first_line"], r["license"]))
    assert [best.get(i, (0, 0, None))[2] for i in range(len(want))] == [name for name, _ in want]


def test_ties_repeated_ids_and_clashing_columns(spark):
    same = [("A", "one two three four five"), ("B", "one two three four five")]
    df = spark.createDataFrame([(1, "one two three four five", "x"), (1, "One, two, three, four, five!", "x"), (1, "other", "x")], "doc_id long, text string, license string")
    assert [(r["doc_id"], r["license"], r["template"], r["dice"]) for r in license_scan(df, templates=same).collect()] == [(1, "A", 0, 1.0)] * 2
