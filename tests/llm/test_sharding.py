import random

import numpy as np

from textloom.llm.sharding import LEAST_SHARDS, place, query, sharding


def brute(sizes, shards, slack):
    room = [sum(s[d] for s in sizes) * slack / shards for d in range(3)]
    left = [[1.0] * 3 for _ in range(shards)]
    out = [0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: -max(sizes[i][d] / room[d] for d in range(3)))
    for i in order:
        x = [sizes[i][d] / room[d] for d in range(3)]
        fit = [k for k in range(shards) if all(left[k][d] - x[d] >= -1e-12 for d in range(3))]
        if fit:
            k = max(fit, key=lambda k: (round(sum(a * b for a, b in zip(left[k], x)), 12), -k))
        else:
            k = max(range(shards), key=lambda k: (min(left[k][d] - x[d] for d in range(3)), -k))
        out[i] = k
        left[k] = [a - b for a, b in zip(left[k], x)]
    return out


def test_against_plain_loops():
    rng = random.Random(5)
    for _ in range(20):
        sizes = [[rng.randint(1, 900), rng.randint(1, 900), rng.randint(1, 9)] for _ in range(rng.randint(1, 60))]
        shards = rng.randint(1, 6)
        assert place(np.array(sizes, float), shards).tolist() == brute(sizes, shards, 1.01)


def test_all_measures_are_even(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = sharding(docs, shard_bytes=1 << 18, least_shards=1).toPandas()
    assert len(rows) == docs.count()
    sums = rows.assign(rows=1).groupby("shard")[["n_bytes", "n_tokens", "rows"]].sum()
    assert len(sums) == -(-rows.n_bytes.sum() // (1 << 18))
    assert (sums.max() / sums.mean() < 1.25).all()
    assert rows.groupby(["source", "lang", "bucket"]).shard.nunique().max() == 1


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, 1), (1, "", "s", "en", 1), (2, "a b", "s", "en", 1), (2, "a b", "s", "en", 1), (3, "c", None, "en", 1)], "doc_id long, text string, source string, lang string, shard int")
    rows = sharding(docs, shard_bytes=2, least_shards=1).collect()
    assert len(rows) == 5
    two = [r for r in rows if r["doc_id"] == 2]
    assert two[0] == two[1]
    null = next(r for r in rows if r["doc_id"] is None)
    assert (null["source"], null["lang"], null["n_bytes"], null["n_tokens"]) == ("", "", 0, 0)
    assert sharding(docs.limit(0)).collect() == []


def test_query_packs_many_shards(spark, medium):
    rows = query(spark, medium).toPandas()
    sums = rows.assign(rows=1).groupby("shard")[["n_bytes", "n_tokens", "rows"]].sum()
    assert len(sums) == LEAST_SHARDS and len(rows) == spark.read.parquet(f"{medium}/documents.parquet").count()
    # the few documents that are longer than a shard's even share fill one each
    most = max(sums.n_bytes.mean() * 1.3, rows.n_bytes.max() * 1.3)
    assert sums.n_bytes.max() <= most and sums.n_bytes.min() > 0


def test_many_cells(spark):
    docs = spark.createDataFrame([(i, f"text of some words number {i} " * (1 + i % 7), f"s{i % 11}", "en") for i in range(3000)], "doc_id long, text string, source string, lang string")
    one = sharding(docs, least_shards=32).toPandas()
    many = sharding(docs, least_shards=32, cell_shards=8).toPandas()
    for rows in (one, many):
        sums = rows.assign(rows=1).groupby("shard")[["n_bytes", "n_tokens", "rows"]].sum()
        assert len(rows) == 3000 and 32 <= len(sums) <= 36
        assert sums.n_bytes.max() < 1.5 * sums.n_bytes.mean()
    assert sorted(one.doc_id) == sorted(many.doc_id)


def test_very_long_text_and_equal_groups(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000, "a", "en"), *((i, "same size", f"s{i}", "en") for i in range(2, 40))], "doc_id long, text string, source string, lang string")
    rows = sharding(docs, least_shards=4).toPandas()
    assert len(rows) == 39 and rows.n_bytes.max() == 1_000_000
    assert (rows[rows.doc_id > 1].shard != rows[rows.doc_id == 1].shard.iloc[0]).all()
