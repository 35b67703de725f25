"""Histograms of attributes, and statistics of corpora, addresses and n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPANS, split_words


def summarize(tagged: DataFrame, name_pattern: str | None = None) -> DataFrame:
    """(name, metric, n, total, lowest, highest) for score and length of every attribute.

    A document without spans of an attribute counts as one of score and length 0.  Scores of names with __label__ are
    1 at most.  One aggregation with partial sums.
    """
    its = tagged.select(F.explode("attributes").alias("name", "spans"))
    if name_pattern:
        its = its.where(F.col("name").rlike(name_pattern))
    zero = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0.0).alias("score"))).cast(SPANS)
    rows = its.select("name", F.explode(F.when(F.size("spans") > 0, F.col("spans")).otherwise(zero)).alias("s"))
    score = F.when(F.col("name").contains("__label__"), F.least("s.score", F.lit(1.0))).otherwise(F.col("s.score"))
    rows = rows.select("name", F.explode(F.create_map(F.lit("score"), score, F.lit("length"), (F.col("s.end") - F.col("s.start")).cast("double"))).alias("metric", "value"))
    return rows.groupBy("name", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


def _frexp(v: Column) -> tuple[Column, Column]:
    """Binary exponent and mantissa of 0.5 up to 1, 0 and 0 for 0; corrected where the logarithm rounds the wrong way."""
    e = F.floor(F.log2(F.abs(v))) + 1
    m = F.abs(v) / F.pow(F.lit(2.0), e)
    e = F.when(v == 0, 0).otherwise(e + (m >= 1).cast("int") - (m < 0.5).cast("int")).cast("int")
    return e, F.when(v == 0, 0.0).otherwise(v / F.pow(F.lit(2.0), e))


def value_buckets(values: DataFrame, value_col: str = "value", digits: int = 5) -> DataFrame:
    """(exponent, mantissa, n, total): values by binary exponent and by mantissa cut to so many decimals, so that buckets are finer for
    smaller values and their number is bounded whatever the data."""
    v = F.col(value_col)
    exponent, mantissa = _frexp(v)
    mantissa = F.floor(mantissa * 10**digits).cast("long")
    return values.where(v.isNotNull()).groupBy(exponent.alias("exponent"), mantissa.alias("mantissa")).agg(F.count("*").alias("n"), F.sum(v).alias("total"))


def bucket_values(buckets) -> tuple[np.ndarray, np.ndarray]:
    """(means, counts) of collected buckets, by rising mean."""
    total, n = (np.array([float(b[k]) for b in buckets]) for k in ("total", "n"))
    mean = total / np.maximum(n, 1)
    order = np.argsort(mean, kind="stable")
    return mean[order], n[order]


def equal_width(values: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, edges) of n bins of equal width, the last closed; at most as many bins as values."""
    if not len(values):
        return np.zeros(0), np.zeros(0)
    if len(values) <= n:
        return counts, np.append(values, values[-1])
    return np.histogram(values, bins=n, weights=counts)


def equal_count(values: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, edges) of n bins of about equal counts: a value heavier than an even share of what is left has a bin of its own, the
    rest is cut where the running count passes the shares."""
    if len(values) <= n:
        return counts, np.append(values, values[-1:] if len(values) else [])
    starts, at = [], 0
    while at < len(values) and len(starts) < n:
        share = counts[at:].sum() / (n - len(starts))
        starts.append(at)
        size = counts[at]
        at += 1
        while at < len(values) and size + counts[at] / 2 < share and len(values) - at > n - len(starts):
            size += counts[at]
            at += 1
    cuts = np.array(starts)
    return np.add.reduceat(counts, cuts), np.append(values[cuts], values[-1])


def histograms(tagged: DataFrame, bins: int = 100, by_count: bool = False, name_pattern: str | None = None) -> DataFrame:
    """(name, metric, bin, low, high, n) of every attribute; only the buckets, whose number is bounded, come to the driver's side."""
    its = tagged.select(F.explode("attributes").alias("name", "spans"))
    if name_pattern:
        its = its.where(F.col("name").rlike(name_pattern))
    zero = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0.0).alias("score"))).cast(SPANS)
    rows = its.select("name", F.explode(F.when(F.size("spans") > 0, F.col("spans")).otherwise(zero)).alias("s"))
    rows = rows.select("name", F.explode(F.create_map(F.lit("score"), F.col("s.score"), F.lit("length"), (F.col("s.end") - F.col("s.start")).cast("double"))).alias("metric", "v"))
    exponent, mantissa = _frexp(F.col("v"))
    mantissa = F.floor(mantissa * 100_000).cast("long")
    buckets = rows.groupBy("name", "metric", exponent.alias("e"), mantissa.alias("m")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))

    def bin_up(pdf):
        import pandas as pd

        values, counts = bucket_values(pdf.to_dict("records"))
        n, edges = (equal_count if by_count else equal_width)(values, counts, bins)
        k = len(n)
        return pd.DataFrame({"name": pdf["name"].iloc[0], "metric": pdf["metric"].iloc[0], "bin": range(k), "low": edges[:k], "high": edges[1 : k + 1], "n": n})

    return buckets.groupBy("name", "metric").applyInPandas(bin_up, "name string, metric string, bin long, low double, high double, n double")


def _among(words: str, wanted: list[str]) -> Column:
    return F.size(F.filter(words, lambda x: x.isin(wanted)))


def corpus_stats(docs: DataFrame, by: list[str], text_col: str = "text") -> DataFrame:
    """Documents, words, characters and bytes of each group, and pronouns of three kinds."""
    words = split_words(F.lower(F.col(text_col)))
    kinds = {"she": "she her hers herself", "he": "he him his himself", "they": "they them their theirs themselves"}
    sums = [F.sum(_among("w", its.split())).alias(f"pronouns_{k}") for k, its in kinds.items()]
    return docs.select(*by, F.col(text_col).alias("t"), words.alias("w")).groupBy(*by).agg(F.count("*").alias("documents"), F.sum(F.size("w")).alias("words"), F.sum(F.length("t")).alias("characters"), F.sum(F.octet_length("t")).alias("bytes"), *sums)


def host_stats(pages: DataFrame, k: int, url_col: str = "url") -> DataFrame:
    """(host, pages) of the k hosts with most pages; hosts that tie in alphabetical order."""
    host = F.lower(F.regexp_extract(url_col, r"^[a-zA-Z]+://([^/?#:]+)", 1))
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "host").limit(k)


#: Groups by hash, in which n-grams are counted by themselves; characters of the texts that are counted together before the shuffle.
_GROUPS, _CHUNK = 1024, 1 << 23


def _pack_ngrams(texts: list[str | None], n: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(group, bytes, n-grams, their counts) of the texts: n-grams in order, one a line, compressed."""
    numbers: dict[str, int] = {}
    ids: list[int] = []
    sizes = []
    for text in texts:
        words = (text or "").split()
        if len(words) >= n:
            ids += [numbers.setdefault(w, len(numbers)) for w in words]
            sizes.append(len(words))
    if not sizes:
        return
    # words by their places in alphabetical order, so that the numbers of n-grams are in order too
    words = sorted(numbers)
    rank = np.empty(len(words), np.int64)
    rank[[numbers[w] for w in words]] = np.arange(len(words))
    its, ends = rank[ids], np.cumsum(sizes)
    inside = np.ones(len(its), bool)
    for k in range(1, n):
        inside[ends - k] = False
    at = np.flatnonzero(inside)
    code, bound = its[at], len(words)
    for k in range(1, n):
        if bound * len(words) >= 1 << 63:  # numbered anew, so that the product fits
            distinct, code = np.unique(code, return_inverse=True)
            bound = len(distinct)
        code, bound = code * len(words) + its[at + k], bound * len(words)
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    hashes = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:8] for w in words), np.uint64)
    at = at[first]
    group = np.zeros(len(at), np.uint64)
    for k in range(n):
        group += hashes[its[at + k]] * np.uint64(pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64))
    group = ((group ^ (group >> np.uint64(32))) % np.uint64(_GROUPS)).astype(np.int16)
    by = np.argsort(group, kind="stable")
    at, group, counts = at[by], group[by], counts[by]
    named, blank = pa.array(words, pa.large_string()), pa.scalar(" ", pa.large_string())
    grams = pc.binary_join_element_wise(*(named.take(pa.array(its[at + k])) for k in range(n)), blank) if n > 1 else named.take(pa.array(its[at]))
    grams = pc.binary_join_element_wise(grams, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    _, offsets, lines = grams.buffers()
    offsets = np.frombuffer(offsets, np.int64)
    cuts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(grams)]):
        joined = lines.slice(offsets[a], offsets[b] - 1 - offsets[a])
        yield int(group[a]), len(joined), pa.compress(joined, "zstd", asbytes=True), pa.compress(counts[a:b].astype("<u4").tobytes(), "zstd", asbytes=True)


def _counted(docs: DataFrame, n: int, text_col: str, least: int, k: int | None = None) -> DataFrame:
    """(ngram, n) of every word n-gram that occurs ``least`` times; with ``k``, of the k most frequent of each group.

    N-grams are counted by chunk of documents, then those of the same hash group come together, packed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(pc.utf8_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False)) // _CHUNK
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                rows = list(_pack_ngrams(batch["text"].slice(a, b - a).to_pylist(), n))
                for at in range(0, len(rows), 256):
                    g, size, grams, counts = zip(*rows[at : at + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(size, pa.int32()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())], ["g", "size", "grams", "counts"])

    def add(table: pa.Table) -> pa.Table:
        grams, counts = [], []
        for size, its, many in zip(table["size"].to_pylist(), table["grams"].to_pylist(), table["counts"].to_pylist()):
            lines = pa.array([pa.decompress(its, size, "zstd", asbytes=True)], pa.binary())
            grams.append(pc.list_flatten(pc.split_pattern(lines.cast(pa.string()), "\n")))
            counts.append(pa.array(np.frombuffer(pa.decompress(many, 4 * len(grams[-1]), "zstd", asbytes=True), np.uint32).astype(np.int64)))
        its = pa.table([pa.chunked_array(grams), pa.chunked_array(counts)], ["ngram", "n"]).group_by("ngram").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        its = its.filter(pc.greater_equal(its["n"], least)).select(["ngram", "n"])
        return its if k is None else its.take(pc.select_k_unstable(its, k, [("n", "descending"), ("ngram", "ascending")]))

    rows = docs.select(F.lower(F.col(text_col)).alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(count, "g int, size int, grams binary, counts binary").groupBy("g").applyInArrow(add, "ngram string, n long")


def ngram_counts(docs: DataFrame, n: int, text_col: str = "text", least: int = 1) -> DataFrame:
    """(ngram, n) of every word n-gram that occurs ``least`` times."""
    return _counted(docs, n, text_col, least)


def top_ngrams(docs: DataFrame, n: int, k: int, text_col: str = "text") -> DataFrame:
    """The k most frequent n-grams, those that tie in alphabetical order.  Groups have no n-gram in common, so theirs are among the k of each."""
    return _counted(docs, n, text_col, 1, k).orderBy(F.desc("n"), "ngram").limit(k)


def covered(spans: str = "spans") -> Column:
    """Characters that the union of an array of spans covers."""
    ordered = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0))).alias("n"), F.greatest(acc["at"], s["end"]).alias("at")),
    )["n"]


def _hits(attribute: str, test, bound: float) -> Column:
    return F.filter(F.coalesce(F.try_element_at("attributes", F.lit(attribute)), F.array().cast(SPANS)), lambda s: test(s["score"], F.lit(bound)))


def rule_coverage(tagged: DataFrame, rules: dict[str, tuple[str, str, float]]) -> DataFrame:
    """(rule, documents, characters) that each rule (attribute, ">" or "<", bound) hits."""
    import operator

    out = None
    for name, (attribute, op, bound) in rules.items():
        test = {">": operator.gt, "<": operator.lt}[op]
        hit = _hits(attribute, test, bound)
        rows = tagged.select(hit.alias("spans")).where(F.size("spans") > 0).select(covered().alias("c")).agg(F.lit(name).alias("rule"), F.count("*").alias("documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("characters"))
        out = rows if out is None else out.unionByName(rows)
    return out
