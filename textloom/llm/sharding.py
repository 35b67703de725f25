"""Vector bin packing of document groups into shards that are even in bytes, tokens and rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, materialize
from .packing import count_tokens

#: Text bytes of a shard at most, and shards of any corpus at least, so that so many readers have one each.
SHARD_BYTES, LEAST_SHARDS = 64 << 20, 64
#: Parts that a shard's worth of one source and language is split into at least.
PARTS = 16
#: Shards that are packed together; more are packed in cells of so many, each by itself.
CELL_SHARDS = 256
#: Room of a shard over its even share.
SLACK = 1.01

_MEASURES = ("bytes", "tokens", "rows")
_PLACED = "source string, lang string, bucket long, shard long"


def place(sizes: np.ndarray, shards: int, slack: float = SLACK) -> np.ndarray:
    """The shard of each row of sizes (items, measures), the items taken by falling largest share, those that tie in the order given.

    Each item goes, of the shards with room for it, to that where the dot product of its size and the room left, both
    as shares of a shard's room, is highest (the first of those that tie); if none has room, to where the least room of any
    measure that would be left is highest.
    """
    room = np.maximum(sizes.sum(0) * slack / shards, 1e-9)
    share = sizes / room
    left, out = np.ones((shards, sizes.shape[1])), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-share.max(1), kind="stable") if len(sizes) else ():
        rest = left - share[i]
        fits = (rest >= -1e-12).all(1)
        score = np.where(fits, left @ share[i], -np.inf) if fits.any() else rest.min(1)
        out[i] = k = int(np.argmax(score))
        left[k] = rest[k]
    return out


def sharding(docs: DataFrame, shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS, parts: int = PARTS, cell_shards: int = CELL_SHARDS, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, lang, bucket, shard, n_bytes, n_tokens) of every row of docs, which has source and lang.

    A shard has ``shard_bytes`` of text, or as little as makes ``least_shards`` of the corpus.  A group is a source's documents of a language, or a hash bucket of them where they are over a sixteenth of a shard: a source that
    holds most of the corpus must not decide the balance.  Groups are placed by place(), in cells of 256 shards; which cell
    is a hash, and each cell gets shards by its bytes, so no task's work grows with the corpus.

    A cell is filled by itself, so a shard may differ from the corpus's even share by as much as cells differ, a 256th part each of many hashed
    groups.

    Edge cases: a null text has 0 bytes and tokens but is a row; a null source or lang is the empty one.  Rows with null or
    repeated ids are sharded like any other; rows that are alike go to the same shard.  Groups that tie are taken by source,
    language and bucket.  Texts are counted whole, however long; one that is longer than a shard has a shard almost to itself.
    Other columns aren't read.  An empty table gives no rows.
    """
    source, lang = (F.coalesce(col(docs, c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang"))
    size = F.coalesce(F.octet_length(col(docs, text_col)), F.lit(0)).cast("long").alias("n_bytes")
    rows = count_tokens(docs, vocabulary, id_col, text_col, source, lang, size)
    totals = materialize(rows.groupBy("source", "lang").agg(F.sum("n_bytes").alias("total")), "totals")
    total = totals.agg(F.sum("total")).first()[0] or 0
    shard_bytes = max(1, min(shard_bytes, -(-total // least_shards)))
    many = totals.select("source", "lang", F.greatest(F.lit(1), F.ceil(F.col("total") * parts / shard_bytes)).cast("long").alias("many"))
    keyed = rows.join(many, ["source", "lang"]).withColumn("bucket", F.pmod("h", "many"))
    groups = keyed.groupBy("source", "lang", "bucket").agg(F.sum("n_bytes").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = materialize(groups, "groups")
    cells = max(1, -(-total // (shard_bytes * cell_shards)))
    groups = groups.withColumn("cell", F.pmod(F.xxhash64("source", "lang", "bucket"), F.lit(cells)))
    # one number for each cell, a 256th of the shards
    need = groups.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / shard_bytes)).cast("long").alias("shards")).orderBy("cell").collect()
    first, at = {}, 0
    for r in need:
        first[r["cell"]] = (at, r["shards"])
        at += r["shards"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("source", "ascending"), ("lang", "ascending"), ("bucket", "ascending")])
        start, shards = first[table["cell"][0].as_py()]
        sizes = np.stack([table[m].to_numpy().astype(np.float64) for m in _MEASURES], 1)
        return table.select(["source", "lang", "bucket"]).append_column("shard", pa.array(place(sizes, shards) + start, pa.int64()))

    placed = materialize(groups.groupBy("cell").applyInArrow(run, _PLACED), "placed")
    return keyed.join(placed, ["source", "lang", "bucket"]).select("doc_id", "source", "lang", "bucket", "shard", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard."""
    return sharding(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))
