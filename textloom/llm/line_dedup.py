"""Removal of lines that many documents share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import NO_ID, col, doc_key, fresh, materialize

THRESHOLD = 5
#: Hashes of 16 bytes up to which the table of shared lines is broadcast; a larger one is joined by a shuffle.
BROADCAST_LINES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 13, 12, 11]] = True


def line_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, h1, h2): a 128-bit hash of the normal form of each line, 0 for blank ones, and each text's first line among them.

    The normal form is lower-cased, with runs of blanks made one and none at the ends.
    """
    first, h1, h2, many = np.zeros(len(texts) + 1, np.int64), [], [], 0
    for at, part in tb.chunks(texts, 1 << 19):
        data, offs = tb.buffers(part)
        blank, newline = _BLANK[data], data == 10
        # a blank follows each text: it and a newline end a line
        edge = newline.copy()
        edge[offs[1:] - 1] = True
        drop = blank.copy()
        drop[1:] &= blank[:-1] | edge[:-1]
        drop[offs[:-1]] |= blank[offs[:-1]]
        drop[offs[1:] - 1] = False
        kept = np.flatnonzero(~drop)
        edge, data = edge[kept], np.where(blank, np.uint8(32), data)[kept]
        end = np.flatnonzero(edge)
        start = np.concatenate([[0], end[:-1] + 1]).astype(np.int64)
        stop = end - ((end > start) & (data[end - 1] == 32))
        one, two = (np.where(stop > start, tb.span_hash(tb.prefix(data, k), start, stop, k), tb.U64(0)) for k in (0, 1))
        h1.append(one)
        h2.append(two)
        lines = np.concatenate([[0], np.cumsum(newline)])[offs[1:]] + np.arange(1, len(part) + 1)
        first[at + 1 : at + 1 + len(part)] = many + lines
        many += len(end)
    join = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
    return first, join(h1), join(h2)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, th, h1, h2) of each row with a text, written in the shared folder: the texts are read and hashed once."""

    def hashes(texts: pa.Array) -> pa.Array:
        first, h1, h2 = line_hashes(texts)
        first = pa.array(first, pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(first, pa.array(h)) for h in (h1, h2)], ["h1", "h2"])

    hashes.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    hashes = F.arrow_udf(hashes, "h1 array<long>, h2 array<long>").asNondeterministic()  # so that it runs once a row
    text = col(docs, text_col)
    rows = docs.where(text.isNotNull()).select(doc_key(docs, id_col).alias("did"), F.xxhash64(text).alias("th"), hashes(text).alias("x"))
    return materialize(rows.select("did", "th", "x.*"), "lines")


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """The texts without the lines at the given places, null where none are given."""
    out = []
    for text, places in zip(texts.to_pylist(), gone.to_pylist()):
        if text is None or places is None:
            out.append(None)
        else:
            places = set(places)
            out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in places))
    return pa.array(out, pa.string())


def line_dedup(docs: DataFrame, threshold: int = THRESHOLD, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, drop_emptied: bool = False) -> DataFrame:
    """docs without the lines that more than ``threshold`` distinct documents hold.

    A line's normal form is lower-cased, with runs of blanks made one and trimmed.  Every line that isn't blank counts, however short
    and in whatever script.  With ``keep_first`` the copy in the document with the lowest id stays, so that of a group of copied documents
    one keeps its text.  The other lines keep their place and spelling.  ``counts`` adds n_lines and n_dropped; ``drop_emptied`` leaves
    out the documents of which nothing but white space is left.

    Plan: each text is read once to hash its lines to 128 bits.  A first count of occurrences, combined before its shuffle, leaves the
    hashes that occur often enough; only their lines go on to the count of distinct documents and to the places that go.  A table of
    at most a million such hashes is broadcast, a larger one joined by a shuffle.  The texts go through one shuffle, to meet the places.

    Edge cases: a null text stays null and holds no line; an empty text holds one empty line.  Rows with the same id count as one
    document, as do rows without an id that have the same text (they sort last, by the text's hash).  A line repeated within a document
    counts once and goes or stays as a whole.  Repeated rows stay.  Texts are read whole, however long.  Of ids that tie there are none:
    the lowest id is unique.  No rows give no rows.  Other columns pass through, whatever their names.
    """
    lines = _hashed(docs, id_col, text_col).select("did", "th", F.posexplode(F.arrays_zip("h1", "h2")).alias("pos", "h")).select("did", "th", "pos", "h.h1", "h.h2")
    lines = lines.where("h1 <> 0 OR h2 <> 0")
    often = materialize(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") > threshold).select("h1", "h2"), "often")
    few = often.count() <= BROADCAST_LINES
    small = F.broadcast if few else lambda x: x
    hits = materialize(lines.join(small(often), ["h1", "h2"]), "hits")
    # rows without an id are told apart by their texts
    own = F.when(F.col("did") == NO_ID, F.col("th")).otherwise(0)
    heavy = hits.groupBy("h1", "h2").agg(F.count_distinct("did", own).alias("n"), F.min(F.struct("did", own.alias("own"))).alias("first")).where(F.col("n") > threshold)
    gone = hits.join(small(heavy.select("h1", "h2", "first")), ["h1", "h2"])
    if keep_first:
        gone = gone.where((F.col("first.did") != F.col("did")) | (F.col("first.own") != own))
    did, th, mask, rest = fresh(docs, "did", "th", "mask", "rest")
    masks = gone.groupBy(F.col("did").alias(did), F.col("th").alias(th)).agg(F.collect_set("pos").alias(mask))
    joined = docs.withColumns({did: doc_key(docs, id_col), th: F.xxhash64(col(docs, text_col))}).join(masks, [did, th], "left")

    def without(texts: pa.Array, places: pa.Array) -> pa.Array:
        return _without(texts, places)

    without.__annotations__ = {"texts": pa.Array, "places": pa.Array, "return": pa.Array}
    without = F.arrow_udf(without, "string").asNondeterministic()
    changed = F.col(mask).isNotNull()
    joined = joined.withColumn(rest, without(F.when(changed, col(joined, text_col)), F.col(mask)))
    new = F.when(changed, F.col(rest)).otherwise(col(joined, text_col))
    out = [new.alias(c) if c == text_col else col(joined, c) for c in docs.columns]
    if counts:
        text = col(joined, text_col)
        out.append(F.coalesce(F.length(text) - F.length(F.translate(text, "\n", "")) + 1, F.lit(0)).cast("long").alias("n_lines"))
        out.append(F.coalesce(F.size(mask), F.lit(0)).cast("long").alias("n_dropped"))
    if drop_emptied:
        joined = joined.where(~changed | F.col(rest).rlike(r"\S"))
    return joined.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after line dedup, with its numbers of lines and of removed lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, counts=True)


SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
normal AS (SELECT doc_id, pos, line, trim(regexp_replace(lower(line), '[ \t\r\f\v]+', ' ', 'g')) AS x FROM lines),
heavy AS (SELECT x FROM normal WHERE x <> '' GROUP BY x HAVING count(DISTINCT doc_id) > {THRESHOLD}),
kept AS (SELECT n.*, h.x IS NOT NULL AS gone FROM normal n LEFT JOIN heavy h ON n.x = h.x)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
  count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped FROM kept GROUP BY doc_id
"""
