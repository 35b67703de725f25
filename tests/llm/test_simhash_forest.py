import random

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import simhash_forest as sf
from textloom.llm import textbatch as tb


def documents(n=400, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}{'abcdefgh'[i % 8]}" for i in range(4000)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.4:
            ws = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, len(ws) // 20, len(ws) // 8])):
                ws[rng.randrange(len(ws))] = rng.choice(words)
        else:
            ws = [rng.choice(words) for _ in range(rng.choice([3, 20, 60, 300]))]
        texts.append(" ".join(ws))
    return texts


def brute_groups(sig, some, ids):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if some[i] and some[j] and sf.near(sig[i], sig[j])]
    for i, j in pairs:
        a, b = sorted((find(i), find(j)), key=lambda k: ids[k])
        root[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}, pairs


def test_signature_is_the_majority_of_distinct_words():
    texts = ["One two two  THREE", "", "a", "x " * 700, " ".join(f"v{i}" for i in range(900))]
    sig, some = sf.signatures(pa.array(texts, pa.large_string()))
    assert some.tolist() == [True, False, True, True, True]
    for t, s in zip(texts, sig):
        data, offs = tb.buffers(pa.array([t], pa.large_string()))
        start, end, _ = tb.words(data, offs)
        words = set((tb.span_hash(tb.prefix(data), start, end) >> np.uint64(24)).tolist())
        assert len(words) == len(set(t.lower().split())) and len(s) == 4
        for w in range(4):
            hashes = tb.mix(np.array(sorted(words), np.uint64) + np.uint64((w + 1) * 0x5851F42D4C957F2D & ((1 << 63) - 1)))
            for bit in range(64):
                votes = int(((hashes >> np.uint64(bit)) & np.uint64(1)).sum())
                want = 2 * votes + ((64 * w + bit) & 1) > len(words) if words else False
                assert bool(int(s[w]) >> bit & 1) == want


def test_recall_formula_and_shape():
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(4000):
        differing = rng.permutation(256)[:40]
        hits += not np.isin(rng.permutation(256)[:10], differing).any()
    assert abs(hits / 4000 - sf.chance(10, 40)) < 0.02
    for docs in (1, 100, 10**5, 10**6, 10**7, 10**8, 10**10):
        trees, depth = sf.shape(docs)
        assert 1 - (1 - sf.chance(depth, sf.MOST_BITS)) ** trees >= sf.RECALL
        # leaves of full depth don't grow with the number of signatures
        assert docs / 2**depth <= sf.LEAF and (docs < 200 or docs / 2**depth > sf.LEAF / 2)


@pytest.mark.parametrize("docs", [10**5, 12 * 10**6, 10**8])
def test_farthest_near_duplicates_are_found_in_leaves_of_full_depth(docs):
    trees, depth = sf.shape(docs)
    assert 1 - (1 - sf.chance(depth, sf.MOST_BITS)) ** trees >= sf.RECALL
    rng = np.random.default_rng(5)
    sig = np.repeat(rng.integers(0, 1 << 63, (1500, 4)).astype(np.uint64), 2, axis=0)
    for row in sig[1::2]:
        for bit in rng.permutation(256)[: sf.MOST_BITS].tolist():
            row[bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    found = np.zeros(1500, bool)
    for tree in range(trees):
        keys = sf.tree_keys(sig, tree)
        order = np.argsort(keys)
        leaf = np.empty(len(sig), np.int64)
        leaf[order] = np.searchsorted(sf.leaves(keys[order], depth - sf.CLIMB, depth, node=1), np.arange(len(sig)), "right")
        found |= leaf[::2] == leaf[1::2]
    assert found.mean() >= 0.93


def test_leaves_follow_the_trie():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64) << np.uint64(1))
    cuts = sf.leaves(keys, 2, 7, node=40)
    size = np.diff([*cuts, len(keys)])
    for a, n in zip(cuts, size):
        part = keys[a : a + n]
        depth = next(d for d in range(64, -1, -1) if d == 0 or (part >> np.uint64(64 - d) == part[0] >> np.uint64(64 - d)).all())
        assert depth >= 2 and (n <= 40 or depth >= 7)


def test_dense_leaves_miss_no_component():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (3, 4)).astype(np.uint64)
    sig = np.concatenate([np.repeat(base, 150, axis=0), rng.integers(0, 1 << 63, (100, 4)).astype(np.uint64)])
    for row in sig:
        for _ in range(4):
            row[rng.integers(4)] ^= np.uint64(1) << np.uint64(rng.integers(63))
    a, b = sf.node_edges(sig, np.array([0]))
    moved, least = sf.spanning(np.arange(len(sig)), a, b)
    groups, _ = brute_groups(sig, np.ones(len(sig), bool), list(range(len(sig))))
    assert {i: groups[i] for i in groups if groups[i] != i} == dict(zip(moved.tolist(), least.tolist()))


@pytest.mark.parametrize("seed", [0, 1])
def test_recall_against_all_pairs(spark, seed):
    texts = documents(seed=seed)
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["group_id"], r["keep"]) for r in sf.near_duplicates(df).collect()}
    sig, some = sf.signatures(pa.array(texts, pa.large_string()))
    want, pairs = brute_groups(sig, some, ids)
    assert len(pairs) > 50
    assert np.mean([got[ids[i]][0] == got[ids[j]][0] for i, j in pairs]) >= 0.95
    assert all(keep == (i == g) for i, (g, keep) in got.items())
    assert np.mean([want[i] == got[i][0] for i in ids]) >= 0.95


def test_components_of_chains(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(500, 400), (400, 450), (450, 500), (600, 600)]
    rng.shuffle(edges)
    got = {r["did"]: r["root"] for r in sf.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 450: 400, 500: 400}
    assert sf.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edge_rows(spark):
    text = "a whole lot of words that make a text of some length"
    rows = [(None, text), (None, None), (1, ""), (2, None), (3, text), (3, text), (4, text + "\n"), (5, "other words altogether here"), (5, "other words altogether here"), (6, "\n \t"), (7, "w" * 300_000)]
    df = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, th string, keep boolean")
    out = sf.near_duplicates(df).collect()
    assert len(out) == len(rows)
    kept = sf.drop_near_duplicates(df)
    assert kept.columns == df.columns
    left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert left == sorted([(None, None), (1, ""), (2, None), (3, text), (5, rows[7][1]), (6, "\n \t"), (7, "w" * 300_000)], key=repr)
    assert sorted(((r["doc_id"], r["keep"]) for r in out), key=repr) == sorted([(None, False), (None, True), (1, True), (2, True), (3, True), (3, False), (4, False), (5, True), (5, False), (6, True), (7, True)], key=repr)
    assert sf.near_duplicates(df.limit(0)).collect() == [] and sf.drop_near_duplicates(df.limit(0)).collect() == []


def test_rows_without_an_id_or_with_a_repeated_one_are_documents_of_their_own(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    # two documents with ids, each near another text without one: no group may join them
    rows = [(None, t) for t in texts] + [(None, texts[0]), (1, texts[3] + " more"), (2, texts[4] + " more"), (5, texts[5] + " x y z"), (5, "other words that are like nothing else here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r["doc_id"], r["text"]) for r in sf.drop_near_duplicates(df).collect()), key=repr)
    assert left == sorted([(None, t) for i, t in enumerate(texts) if i not in (3, 4, 5)] + rows[41:], key=repr)
    out = sf.near_duplicates(df).collect()
    assert len(out) == len(rows) and sum(r["keep"] for r in out) == len(left)
    assert sorted(r["group_id"] for r in out if r["group_id"] is not None) == [1, 1, 2, 2, 5, 5, 5]


@pytest.mark.parametrize("seed", range(6))
def test_components_that_a_single_pair_joins_are_found(seed):
    rng = np.random.default_rng(20 + seed)
    base = rng.integers(0, 1 << 63, (4, 4)).astype(np.uint64)
    links = []
    for x in base:  # chains of pairs at the limit, from a member of each group on
        links.append(x.copy())
        for _ in range(9):
            y = links[-1].copy()
            for bit in rng.permutation(256)[:45].tolist():
                y[bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
            links.append(y)
    sig = np.concatenate([flipped(rng, np.repeat(base, 150, 0), 30), np.array(links), rng.integers(0, 1 << 63, (200, 4)).astype(np.uint64)])
    sig = sig[rng.permutation(len(sig))]
    moved, least = sf.spanning(np.arange(len(sig)), *sf.node_edges(sig, np.array([0])))
    groups, _ = brute_groups(sig, np.ones(len(sig), bool), list(range(len(sig))))
    assert {i: groups[i] for i in groups if groups[i] != i} == dict(zip(moved.tolist(), least.tolist()))


def flipped(rng, sig, most):
    for row in sig:
        for bit in rng.permutation(256)[: rng.integers(0, most + 1)].tolist():
            row[bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    return sig


def components_of(spark, sig, **how):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(sig.view(np.int64).tolist())], "did long, s0 long, s1 long, s2 long, s3 long")
    edges = sf.forest_edges(df, len(sig), **how)
    assert edges.count() < 3 * len(sig) * how["trees"]
    found = {r["did"]: r["root"] for r in sf.components(edges).collect()}
    return [found.get(i, i) for i in range(len(sig))]


def test_large_leaves_are_searched_in_blocks_as_completely(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, (3, 4)).astype(np.uint64) << np.uint64(1)
    # two groups of near copies, a chain that hangs on one copy, and texts that are like nothing else
    copies = flipped(rng, np.concatenate([np.repeat(base[:1], 900, 0), np.repeat(base[1:2], 400, 0)]), 12)
    chain = [copies[5].copy()]
    for _ in range(12):
        chain.append(flipped(rng, chain[-1][None].copy(), 0)[0])
        for bit in rng.permutation(256)[:45].tolist():
            chain[-1][bit >> 6] ^= np.uint64(1) << np.uint64(bit & 63)
    others = rng.integers(0, 1 << 63, (300, 4)).astype(np.uint64)
    sig = np.unique(np.concatenate([copies, np.array(chain[1:]), others]), axis=0)
    sig = sig[rng.permutation(len(sig))]
    want, _ = brute_groups(sig, np.ones(len(sig), bool), list(range(len(sig))))
    want = [want[i] for i in range(len(sig))]
    # one tree of no real depth: its two leaves together must give what the blocks give
    whole = components_of(spark, sig, trees=2, depth=1)
    large, _ = sf.large_leaves(spark.createDataFrame([(i, *row) for i, row in enumerate(sig.view(np.int64).tolist())], "did long, s0 long, s1 long, s2 long, s3 long"), len(sig), 2, 1, 60)
    assert sum(map(len, large.values())) >= 3
    assert components_of(spark, sig, trees=2, depth=1, block=60) == whole
    trees, depth = sf.shape(100)
    assert np.mean([a == b for a, b in zip(components_of(spark, sig, trees=trees, depth=depth, block=60), want)]) > 0.95


def test_nodes_that_span_batches(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (40, 4)).astype(np.uint64)
    sig = np.unique(flipped(rng, np.repeat(base, 700, 0), 10), axis=0)
    assert len(sig) > 20_000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = components_of(spark, sig, trees=3, depth=2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(set(got)) == 40


def test_scripts_without_blanks(spark):
    rng = random.Random(9)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(800))
    other = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(800))
    thai = "".join(chr(rng.randrange(0x0E01, 0x0E2E)) for _ in range(900))
    rows = [(1, text), (2, text[:300] + "一" + text[301:600] + "丁" + text[601:]), (3, other), (4, thai), (5, thai[:400] + "กขค" + thai[400:])]
    got = {r["doc_id"]: r["group_id"] for r in sf.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_many_rows_alike_in_id_and_text(spark):
    rows = [(None, "the very same text without an id", k) for k in range(500)] + [(1, "another text of some words", 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, every int")
    left = sf.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(0, rows[0][1]), (1, rows[-1][1])]
    assert sum(r["keep"] for r in sf.near_duplicates(df).collect()) == 2
