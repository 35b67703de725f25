"""Tokenising, packing into flat arrays, resharding, and text rewrites before it."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import unit


def dtype_for(vocabulary: int) -> np.dtype:
    """The smallest unsigned type that holds the ids."""
    return next(np.dtype(t) for t in ("uint8", "uint16", "uint32", "uint64") if vocabulary - 1 <= np.iinfo(t).max)


def file_encoder(path: str, by_paragraph: bool = False) -> Callable[[], Callable[[str], list[int]]]:
    """Makes, in a worker, encode(text) -> ids by a file of the tokenizers library.

    ``by_paragraph`` encodes each line with the newlines before it by itself, which bounds the length of what is encoded at once.
    """

    def make():
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        one = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
        if not by_paragraph:
            return one
        return lambda t: [i for m in re.finditer(r"\n*[^\n]+|\n+", t) for i in one(m[0])]

    return make


def tokenize(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], bos: int | None = None, eos: int | None = None, truncate: int | None = None, truncate_left: bool = False, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, tokens) of every document that isn't blank; its text is stripped first.

    ``bos`` and ``eos`` are put at the ends unless they are there; then ``truncate`` tokens are kept, of the end if ``truncate_left``.
    """
    kind = pa.list_(pa.int64())
    cache: list = []

    def run(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.append(encoder())
        return pa.array([cache[0](t.strip()) if t and t.strip() else None for t in texts.to_pylist()], kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    rows = docs.select(docs[id_col].alias("id"), F.arrow_udf(run, "array<bigint>").asNondeterministic()(docs[text_col]).alias("tokens")).where("tokens IS NOT NULL")
    return rows.select("id", specials(F.col("tokens"), bos, eos, truncate, truncate_left).alias("tokens"))


def specials(tokens: Column, bos: int | None, eos: int | None, truncate: int | None = None, truncate_left: bool = False) -> Column:
    if bos is not None:
        tokens = F.when(F.coalesce(F.get(tokens, F.lit(0)) == bos, F.lit(False)), tokens).otherwise(F.concat(F.array(F.lit(bos).cast("long")), tokens))
    if eos is not None:
        tokens = F.when(F.coalesce(F.get(tokens, F.size(tokens) - 1) == eos, F.lit(False)), tokens).otherwise(F.concat(tokens, F.array(F.lit(eos).cast("long"))))
    if truncate is not None:
        size = F.size(tokens)
        start = F.greatest(size - truncate, F.lit(0)) + 1 if truncate_left else F.lit(1)
        tokens = F.when(size > truncate, F.slice(tokens, start, F.lit(truncate))).otherwise(tokens)
    return tokens


def shuffled(docs: DataFrame, id_col: str = "id", seed: int = 0) -> DataFrame:
    """docs in an order that the seed fixes, whatever the partitions: sorted by a hash over all of them."""
    return docs.orderBy(unit(docs[id_col], seed), docs[id_col])


def token_offsets(counted: DataFrame, shards: int, id_col: str = "id", n_col: str = "n_tokens", seed: int = 0) -> DataFrame:
    """counted with the shard of each document and its place (start, end) there; documents are never split.

    Shards are by a hash of the id, so the running sums never leave a partition.
    """
    shard = F.floor(unit(F.col(id_col), seed) * shards)
    order = Window.partitionBy("shard").orderBy(unit(F.col(id_col), seed + 1), id_col).rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.withColumn("shard", shard).withColumn("end", F.sum(n_col).over(order))
    return rows.withColumn("start", F.col("end") - F.col(n_col))


def write_memmap(tokens: DataFrame, path: str, shards: int, vocabulary: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Writes (id, tokens) as flat arrays of the smallest type and lists of (start, end, id) beside them; returns (shard, documents, tokens).

    ``path`` is a folder that all executors share.  A shard is written under a name of its attempt and renamed, so that a
    repeated task does no harm.
    """
    import gzip
    import os

    kind = dtype_for(vocabulary)

    def write(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        order = np.argsort(table["rank"].to_numpy(), kind="stable")
        name = f"{path}/part-{shard:05d}"
        tag = f".{os.getpid()}-{random.randrange(1 << 40):x}"
        at = 0
        os.makedirs(path, exist_ok=True)
        with open(f"{name}.npy{tag}", "wb") as f, gzip.open(f"{name}.csv.gz{tag}", "wt") as g:
            for i in order.tolist():
                ids = np.asarray(table["tokens"][i].as_py(), kind)
                f.write(ids.tobytes())
                g.write(f"{at},{at + len(ids)},{table['id'][i].as_py()}\n")
                at += len(ids)
        for end in ("npy", "csv.gz"):
            os.replace(f"{name}.{end}{tag}", f"{name}.{end}")
        return pa.table({"shard": [shard], "documents": [len(table)], "tokens": [at]})

    rows = tokens.select(F.col(id_col).cast("string").alias("id"), "tokens", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(shards)).alias("shard"), F.xxhash64(F.lit(seed + 1), F.col(id_col)).alias("rank"))
    return rows.groupBy("shard").applyInArrow(write, "shard long, documents long, tokens long")


def read_memmap(path: str, vocabulary: int) -> Iterator[tuple[str, np.ndarray]]:
    """(id, tokens) of the documents of a folder that write_memmap() wrote."""
    import csv
    import glob
    import gzip

    for name in sorted(glob.glob(f"{path}/*.npy")):
        data = np.memmap(name, dtype_for(vocabulary), "r") if __import__("os").path.getsize(name) else np.zeros(0, dtype_for(vocabulary))
        with gzip.open(name.removesuffix(".npy") + ".csv.gz", "rt") as f:
            for start, end, doc_id, *_ in csv.reader(f):
                yield doc_id, np.asarray(data[int(start) : int(end)])


def group_by_size(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Files in groups of ``most`` tokens at most, largest first, each to the first group with room; a larger file is a group of its own."""
    groups: list[tuple[int, list[str]]] = []
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        for k, (total, names) in enumerate(groups):
            if total + n <= most and name not in names:
                groups[k] = (total + n, [*names, name])
                break
        else:
            groups.append((n, [name]))
    return [names for _, names in groups]


def merge_offsets(docs: DataFrame) -> DataFrame:
    """(merged, start, end, ...) of documents (merged, file, start, end) whose files are joined in the order of their names."""
    sizes = docs.groupBy("merged", "file").agg(F.max("end").alias("size"))
    before = Window.partitionBy("merged").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    return docs.join(base, ["merged", "file"]).withColumn("start", F.col("start") + F.col("base")).withColumn("end", F.col("end") + F.col("base")).drop("base")


def fill_in_middle(docs: DataFrame, rate: float, psm_share: float = 0.5, prefix: str = "<|fim_prefix|>", middle: str = "<|fim_middle|>", suffix: str = "<|fim_suffix|>", file_sep: str = "<|file_sep|>", seed: int = 0, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """docs with files cut in three and reordered: each part of a text between file separators, with chance ``rate``, at two
    different places; prefix-suffix-middle with chance ``psm_share``, else suffix-prefix-middle.  Id and seed decide."""

    def rewrite(ids: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for i, text in zip(ids.to_pylist(), texts.to_pylist()):
            rng = random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8], "big"))
            out.append(None if text is None else file_sep.join(_fim(part, rng, rate, psm_share, prefix, middle, suffix) for part in text.split(file_sep)))
        return pa.array(out, pa.string())

    rewrite.__annotations__ = {"ids": pa.Array, "texts": pa.Array, "return": pa.Array}
    return docs.withColumn(text_col, F.arrow_udf(rewrite, "string")(docs[id_col], docs[text_col]))


def _fim(text: str, rng: random.Random, rate: float, psm_share: float, prefix: str, middle: str, suffix: str) -> str:
    if len(text) < 2 or rng.random() >= rate:
        return text
    a, b = sorted(rng.sample(range(len(text) + 1), 2))
    p, m, s = text[:a], text[a:b], text[b:]
    return f"{prefix}{p}{suffix}{s}{middle}{m}" if rng.random() < psm_share else f"{prefix}{suffix}{s}{middle}{p}{m}"


def sanitize(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after another."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def training_lines(docs: DataFrame, label_col: str, mode: str = "document", newline: str = "replace", text_col: str = "text") -> DataFrame:
    """(value) lines "__label__x text" for a text classifier, by document, paragraph or sentence; newlines are kept, skipped or made blanks."""
    body = {"document": F.array(F.col(text_col)), "paragraph": F.split(text_col, r"\n", -1), "sentence": F.regexp_extract_all(F.col(text_col), F.lit(r"[^.!?\n]+[.!?]*"), 0)}[mode]
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.explode(body).alias("t"))
    text = F.trim(F.translate("t", "\n", {"replace": " ", "skip": "", "keep": "\n"}[newline])) if newline != "keep" else F.trim("t")
    return rows.select("label", text.alias("t")).where("t <> ''").select(F.concat(F.lit("__label__"), F.regexp_replace("label", r"\s+", "_"), F.lit(" "), F.col("t")).alias("value"))


def train_classifier(train: DataFrame, features: int = 1 << 18):
    """A Spark ML pipeline (text, label) of hashed words and word pairs and logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import SQLTransformer, HashingTF, NGram, RegexTokenizer

    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\s+"),
            NGram(n=2, inputCol="w", outputCol="pairs"),
            SQLTransformer(statement="SELECT *, concat(w, pairs) AS grams FROM __THIS__"),
            HashingTF(numFeatures=features, inputCol="grams", outputCol="features"),
            LogisticRegression(maxIter=20, regParam=1e-3),
        ]
    ).fit(train)
