import random

import pytest

from textloom.llm import decontaminate as d


def distance(pattern, text):
    """Least edit distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        left, new = i, [i]
        for j, t in enumerate(text, 1):
            left = min(row[j] + 1, left + 1, row[j - 1] + (c != t))
            new.append(left)
        row = new
    return min(row)


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(len(text) or 1)
        text = rng.choice([text[:k] + rng.choice("abc ") + text[k:], text[:k] + text[k + 1 :], text[:k] + rng.choice("abc") + text[k + 1 :]])
    return text


@pytest.mark.parametrize("seed", range(6))
def test_against_all_distances(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(9, 25)))) for i in range(8)]
    searcher = d.Searcher(items, 0.1)
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(0, 3)):
            parts += [word() for _ in range(rng.randint(0, 9))]
            item = rng.choice(items)[1]
            parts.append(edited(rng, item, rng.choice([0, 1, len(item) // 12, len(item) // 10, len(item) // 8, len(item) // 6])))
        text = " ".join(parts)
        got = {searcher.items[i][0]: x for i, x in searcher.search(text).items()}
        plain = d.normal(text)
        for i, item in items:
            item = d.normal(item)
            best = distance(item, plain)
            assert (i in got) == (best <= int(0.1 * len(item))), (best, len(item))
            if i in got:
                found, start, stop = got[i]
                assert found == best
                assert distance(item, plain[start:stop]) == found


@pytest.mark.parametrize("seed", range(4))
def test_best_place_of_repetitive_and_short_items(seed):
    rng = random.Random(100 + seed)
    for _ in range(150):
        items = [(i, "".join(rng.choice("ab ") for _ in range(rng.choice([1, 2, 5, 9, 10, 20, 40])))) for i in range(4)]
        items = [(i, t) for i, t in items if d.normal(t)]
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 3)):
            text += edited(rng, rng.choice(items)[1], rng.randint(0, 3)) if items else ""
        searcher, plain = d.Searcher(items), d.normal(text)
        got = {searcher.items[i][0]: x for i, x in searcher.search(text).items()}
        first = searcher.search(text, True)
        for i, item in items:
            item = d.normal(item)
            best = distance(item, plain) if plain else len(item)
            assert (i in got) == (best <= int(0.1 * len(item)) and bool(plain)), (item, plain)
            if i in got:
                assert got[i][0] == best == distance(item, plain[got[i][1] : got[i][2]])
        assert bool(first) == bool(got)


def test_myers_is_the_edit_distance():
    rng = random.Random(9)
    for _ in range(500):
        p = "".join(rng.choice("ab") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))
        want = distance(p, t)
        got = d.myers(d.masks(p), len(p), t, len(p))
        assert (got[0] if got else len(p)) == want


def test_leaves_cover_the_item():
    for n, k in ((40, 0), (40, 1), (100, 9), (77, 6)):
        text = "".join(chr(97 + i % 26) for i in range(n))
        leaves = d.tree(text, k)
        assert len(leaves) == k + 1
        assert "".join(text[x.start : x.stop] for x in leaves) == text


def test_edge_rows(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "a rather short one"), (None, item.upper()), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(7, "Before\n" + item.replace(" ", "\n\t") + " after", 1), (None, item, 1), (8, None, 1), (9, "", 1), (7, "clean", 1), (10, "x " * 100_000 + item, 1)], "doc_id long, text string, distance int")
    rows = sorted(((r["doc_id"], r["item_id"], r["start"], r["stop"], r["distance"]) for r in d.matches(docs, items).collect()), key=repr)
    places = {7: 7, None: 0, 10: 200_000}
    assert rows == sorted([(i, k, at, at + len(item), 0) for i, at in places.items() for k in (1, 1, None)], key=repr)
    left = d.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [7, 8, 9]
    assert d.matches(docs, items.limit(0)).collect() == [] and d.decontaminate(docs, items.limit(0)).count() == 6
    assert d.matches(docs.limit(0), items).collect() == []


def test_slices_find_the_same(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, d.matches(docs, items).collect()))
    many = sorted(map(tuple, d.matches(docs, items, slice_chars=3000).collect()))
    assert one == many and one
