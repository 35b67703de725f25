import random

import pytest

from textloom.llm import packing as p
from textloom.llm.tokens import PATTERN, TokenCounter, read_vocabulary

TIERS = (16, 64, 256)


def check(lengths, rows, tiers=TIERS, step=512):
    """Every token of every document once, windows not overfull, steps neither."""
    by, windows, steps = {}, {}, {}
    for s, tier, w, place, order, start, n in rows:
        by.setdefault(order, []).append((start, n))
        windows.setdefault(w, []).append((tier, s, place, n))
    for n, order in lengths:
        at = 0
        for start, size in sorted(by.get(order, [])):
            assert start == at and size > 0
            at += size
        assert at == n
    for w, parts in windows.items():
        assert len({(t, s) for t, s, _, _ in parts}) == 1
        assert sum(n for *_, n in parts) <= parts[0][0]
        assert sorted(x[2] for x in parts) == list(range(len(parts)))
        steps[parts[0][1]] = steps.get(parts[0][1], 0) + parts[0][0]
    assert all(x <= max(step, max(tiers)) for x in steps.values())
    assert sorted(steps) == list(range(len(steps)))
    return windows, steps


@pytest.mark.parametrize("seed", range(8))
def test_random_documents(seed):
    rng = random.Random(seed)
    lengths = [(rng.choice([1, 3, 15, 16, 17, 40, 64, 65, 200, 256, 257, 1000]), i) for i in range(rng.choice([1, 5, 200]))]
    rows = p.pack(lengths, TIERS, 512)
    windows, steps = check(lengths, rows)
    total = sum(n for n, _ in lengths)
    # no document sits in a longer tier's window of its own if a shorter tier would hold all of it
    for parts in windows.values():
        tier = parts[0][0]
        assert max(n for *_, n in parts) > max([t for t in TIERS if t < tier], default=0)
    if len(lengths) == 200:
        assert total / sum(parts[0][0] for parts in windows.values()) > 0.9


def test_gaps_of_long_windows_take_shorter_documents():
    rows = p.pack([(200, 0), (50, 1), (6, 2)], TIERS, 512)
    assert {(t, w) for _, t, w, *_ in rows} == {(256, 0)}


def test_steps_are_balanced():
    rng = random.Random(1)
    lengths = [(rng.randint(1, 256), i) for i in range(3000)]
    rows = p.pack(lengths, TIERS, 2048)
    spent = {}
    for s, _, _, _, _, _, n in rows:
        spent[s] = spent.get(s, 0) + n * (n + p.LINEAR)
    full = sorted(spent.values())[1:]  # one step may be short of windows
    assert max(full) < 1.2 * min(full)


def test_nothing_to_pack():
    assert p.pack([], TIERS) == []


def test_counter_counts_as_the_encoder_does():
    import base64

    import tiktoken

    raw = read_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    encode = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = random.Random(3)
    parts = ["a", " ", "  ", "   ", "\n", " \n", "\n ", "it's", "don't", "12", "é", "😊", "!!", "word", "\t", "<|endoftext|>", "The", "x1"]
    small = TokenCounter(raw, kept=5)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert small.count(text) == len(encode(text)), repr(text)
    assert small.count(None) == 0


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, "one two", 5), (1, None, 5), (2, "", 5), (3, "same text", 5), (3, "same text", 5), (4, "word " * 50_000, 5)], "doc_id long, text string, n_tokens int")
    rows = p.packing(docs).collect()
    assert sorted((r["doc_id"] for r in rows if r["doc_id"] != 4), key=repr) == [3, 3, None]
    long = sorted((r["doc_start"], r["n_tokens"], r["tier"]) for r in rows if r["doc_id"] == 4)
    assert long[0] == (0, 32768, 32768) and sum(n for _, n, _ in long) > 50_000 and long[1][0] == 32768
    assert p.packing(docs.limit(0)).collect() == []


def test_groups_are_packed_alike_whatever_the_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = p.packing(docs, group_tokens=20_000)
    b = p.packing(docs.repartition(7), group_tokens=20_000)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.select("pack").distinct().count() > 3


def plain_pack(lengths, tiers, step_tokens):
    """The packing by plain loops over all windows and all segments."""
    tiers = sorted(tiers)
    pools = {t: [] for t in tiers}
    for n, order in lengths:
        for start in range(0, n, tiers[-1]):
            size = min(n - start, tiers[-1])
            pools[min(t for t in tiers if t >= size)].append((size, order, start))
    made = []
    for t in reversed(tiers):
        windows = []
        for s in sorted(pools[t], key=lambda s: (-s[0], s[1], s[2])):
            fits = [w for w in windows if t - sum(x[0] for x in w) >= s[0]]
            if fits:
                min(fits, key=lambda w: (t - sum(x[0] for x in w), windows.index(w))).append(s)
            else:
                windows.append([s])
        room = lambda w: t - sum(x[0] for x in w)
        for w in sorted(windows, key=lambda w: (room(w), w[0][1], w[0][2])):
            for u in [u for u in reversed(tiers) if u < t]:
                while fits := [s for s in pools[u] if s[0] <= room(w)]:
                    s = min(fits, key=lambda s: (-s[0], s[1], s[2]))
                    pools[u].remove(s)
                    w.append(s)
        made += [(t, w) for w in windows]
    many = -(-sum(t for t, _ in made) // max(step_tokens, max((t for t, _ in made), default=1)))
    steps = [[0, max(step_tokens, max((t for t, _ in made), default=1))] for _ in range(many)]
    full, of = max(step_tokens, max((t for t, _ in made), default=1)), {}
    for i in sorted(range(len(made)), key=lambda i: (-made[i][0], -p.cost(made[i][1]), i)):
        t, w = made[i]
        fits = [k for k, (_, left) in enumerate(steps) if left >= t]
        if not fits:
            steps.append([0, full])
            fits = [len(steps) - 1]
        k = min(fits, key=lambda k: (steps[k][0], k))
        steps[k][0] += p.cost(w)
        steps[k][1] -= t
        of[i] = k
    return [(of[i], t, i, place, order, start, n) for i, (t, w) in enumerate(made) for place, (n, order, start) in enumerate(w)]


@pytest.mark.parametrize("seed", range(12))
def test_against_plain_loops(seed):
    rng = random.Random(50 + seed)
    # many ties: few lengths
    lengths = [(rng.choice([1, 2, 15, 16, 17, 40, 64, 65, 200, 256, 257, 1000] if seed % 2 else range(1, 400)), i) for i in range(rng.choice([0, 1, 30, 150]))]
    assert sorted(p.pack(lengths, TIERS, 512)) == sorted(plain_pack(lengths, TIERS, 512))


def test_several_groups_fill_about_as_well_as_one(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(int(rng.lognormvariate(6, 1.2)) + 1))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fill = []
    for group in (1 << 40, 1 << 18):
        out = p.packing(docs, group_tokens=group).toPandas()
        windows = out.drop_duplicates(["pack", "window"])
        fill.append(out.n_tokens.sum() / windows.tier.sum())
        assert out.groupby("doc_id").n_tokens.sum().shape[0] == 1500
    # what packing in groups of eight long windows loses
    assert fill[0] > 0.99 and fill[1] > fill[0] - 0.02, fill
