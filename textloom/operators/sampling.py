"""Sampling and simple selections of documents, the same at each run."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, unit


def hash_suffixes(probability: float) -> list[str]:
    """Hexadecimal endings whose share of all hashes is the probability, rounded to one digit: digits from f downwards, after as
    many f as it takes for one digit to hold the share."""
    if not 0 < probability <= 1:
        raise ValueError("a probability is over 0 and 1 at most")
    head = ""
    while probability * 16 < 1:
        head, probability = head + "f", probability * 16
    return [head + "fedcba9876543210"[k] for k in range(round(probability * 16))]


def hash_sample(docs: DataFrame, probability: float, complement: bool = False, text_col: str = "text") -> DataFrame:
    """Documents whose text's MD5 ends in one of hash_suffixes(); equal texts are taken or left together.  Null texts are left out."""
    ends = hash_suffixes(probability)
    hit = F.substring(F.md5(F.col(text_col)), -len(ends[0]), len(ends[0])) >= min(ends)
    return docs.where(~hit if complement else hit)


def random_share(doc_id: Column, probability: float, seed: int = 0) -> Column:
    """Whether a document is in a random share, by its id."""
    return unit(doc_id, seed) < probability


def without_empty(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents whose text isn't blank or null."""
    return docs.where(strip(F.col(text_col)) != "")


def sample_paths(paths: list[str], probability: float) -> list[str]:
    """Paths in a random share, by their names."""
    most = int(probability * (1 << 64))
    return [p for p in paths if int.from_bytes(hashlib.sha256(p.encode()).digest()[:8], "big") < most]


def resample(rows: DataFrame, rate: Column | float, key: Column, seed: int = 0) -> DataFrame:
    """rows taken ``rate`` times on average: so many whole copies, and one more for the fractional part's share of keys.  A copy's
    number is in the column ``copy``."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    copies = (F.floor(rate) + (unit(key, seed) < rate - F.floor(rate)).cast("long")).cast("int")
    return rows.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))


def mixture_rates(sizes: DataFrame, wanted: DataFrame, total_tokens: int) -> DataFrame:
    """(topic, rate): how often each topic (topic, n_tokens) is taken for its share of ``total_tokens`` by weights (topic, weight)."""
    both = sizes.join(wanted, "topic")
    weight = both.agg(F.sum("weight").alias("all")).withColumn("one", F.lit(1))  # a single row
    return both.withColumn("one", F.lit(1)).join(weight, "one").select("topic", (F.col("weight") / F.col("all") * total_tokens / F.col("n_tokens")).alias("rate"))
