"""Exact, deterministic deduplication of documents, paragraphs and n-grams, and matching against a seed set."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPANS, split_words, strip


def _long_enough(text: Column, min_length: int, min_words: int, skip_empty: bool, octets: bool) -> Column:
    ok = text.isNotNull()
    if skip_empty:
        ok &= strip(text) != ""
    if min_length:
        ok &= (F.octet_length(text) if octets else F.length(text)) >= min_length
    if min_words:
        ok &= F.size(split_words(text)) >= min_words
    return ok


def _hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _repeats(rows: DataFrame, order: list[str], seeds: DataFrame | None, read_only: bool) -> DataFrame:
    """rows with repeat: whether an earlier row, or a seed (k), has its key k, and head: whether it is the first of several; rows without a key are
    neither.  Rows that are equal in all of ``order`` come first together.

    The first row of each key comes from an aggregation, which combines before its shuffle; keys that occur once go no further.  Rows then
    meet the keys that occur several times in a plain join, which the engine may broadcast or split where a key is hot.  Rows without a key have
    one of their own there, so that they don't come together.  rows are computed once for each of the two, so order must not hold what another
    run may change, such as numbers given after a shuffle.
    """
    own = F.coalesce("k", F.encode(F.xxhash64(*order).cast("string"), "utf-8"))
    rows = rows.withColumn("repeat", F.lit(False)).withColumn("head", F.lit(False)).withColumn("_k", own)
    if not read_only:
        place = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c))])
        first = rows.where("k IS NOT NULL").groupBy(F.col("k").alias("_k")).agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        rows = rows.drop("repeat", "head").join(first, "_k", "left").withColumn("repeat", F.coalesce(place != F.col("_first"), F.lit(False))).withColumn("head", F.coalesce(place == F.col("_first"), F.lit(False))).drop("_first")
    if seeds is not None:
        known = seeds.select(F.col("k").alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, "_k", "left").withColumn("repeat", F.col("repeat") | F.coalesce("_known", F.lit(False))).drop("_known")
    return rows.drop("_k")


def dedupe_documents(docs: DataFrame, key: str = "text", id_col: str = "id", order_by: list[str] | None = None, min_length: int = 0, min_words: int = 0, skip_empty: bool = False, seeds: DataFrame | None = None, read_only: bool = False) -> DataFrame:
    """(id, duplicates) of every document: one span of the key's bytes if an earlier document, or one of ``seeds`` (key), has the key.

    Keys under ``min_length`` bytes or ``min_words`` words, and with ``skip_empty`` blank ones, are never duplicates.  ``read_only``
    compares with the seeds alone.  Documents that tie in order come by their ids; of those that share id and key too, one is the first.
    Hashes of 128 bits are shuffled, never keys.
    """
    value = docs[key].cast("string")
    order = [f"o{i}" for i in range(len(order_by or [id_col]))]
    rows = docs.select(docs[id_col].alias("id"), *[docs[c].alias(o) for o, c in zip(order, order_by or [id_col])], F.octet_length(value).alias("size"), F.when(_long_enough(value, min_length, min_words, skip_empty, True), _hash(value)).alias("k"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    rows = _repeats(rows, [*order, "id"], seeds and seeds.select(_hash(F.col(seeds.columns[0]).cast("string")).alias("k")), read_only)
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end"), F.lit(1.0).alias("score")))
    again = F.col("repeat") | ((F.col("copy") > 1) & F.col("k").isNotNull() & F.lit(not read_only))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("id", F.when(again, span).otherwise(F.array().cast(SPANS)).alias("duplicates"))


_PART = "array<struct<start:bigint,end:bigint,k:binary>>"


def _cut_paragraphs(separator: str, min_length: int, min_words: int, skip_empty: bool):
    """A column function: the parts of a text with their spans, which leave out the separator, whose first character alone separates spans, and
    their hashes, null for those that aren't compared."""

    def cut(texts: pa.Array) -> pa.Array:
        sizes, starts, ends, keys = [0], [], [], []
        for text in texts.to_pylist():
            at = 0
            for body in text.split(separator) if text is not None else ():
                starts.append(at)
                at += len(body)
                ends.append(at)
                at += 1
                ok = len(body) >= min_length and not (skip_empty and not body.strip()) and not (min_words and len(body.split()) < min_words)
                keys.append(hashlib.md5(body.encode("utf-8", "surrogatepass")).digest() if ok else None)
            sizes.append(len(starts))
        parts = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(keys, pa.binary())], ["start", "end", "k"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), parts)

    cut.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(cut, _PART).asNondeterministic()  # so that it runs once a row


def dedupe_paragraphs(docs: DataFrame, text_col: str = "text", id_col: str = "id", order_by: list[str] | None = None, separator: str = "\n", min_length: int = 0, min_words: int = 0, skip_empty: bool = False, seeds: DataFrame | None = None, read_only: bool = False) -> DataFrame:
    """(id, duplicates) of every document: spans of its paragraphs that occurred before, in it or in an earlier document or a seed.

    Each text is cut and hashed where it is read; places and hashes alone are shuffled.  Documents that tie in order come by their ids, those
    that share an id by the hash of their text, and of equal ones one is the first.
    """
    own = _own(docs, text_col, id_col, order_by)
    names = [f"u{i}" for i in range(len(own))]
    cut = _cut_paragraphs(separator, min_length, min_words, skip_empty)
    rows = docs.select(*own, cut(docs[text_col]).alias("parts")).select(*names, F.posexplode("parts").alias("pos", "p")).select(*names, "pos", "p.*").where("k IS NOT NULL")
    some = _repeats(rows, [*names, "pos"], seeds and seeds.select(_hash(F.col(seeds.columns[0])).alias("k")), read_only)
    span = F.struct("start", "end", F.lit(1.0).alias("score"))
    return _collect(docs.select(*own), some.where("repeat OR head").select(*names, F.when(F.col("repeat"), span).alias("span"), span.alias("later")))


def _own(docs: DataFrame, text_col: str, id_col: str, order_by: list[str] | None) -> list[Column]:
    """What places a document and tells it apart: u0 and so on, by which it is ordered, then its id, then the hash of its text."""
    return [c.alias(f"u{i}") for i, c in enumerate([*(docs[c] for c in order_by or []), docs[id_col], F.xxhash64(docs[text_col])])]


def _collect(own: DataFrame, found: DataFrame) -> DataFrame:
    """(id, duplicates) of every row of own, with the spans of the rows of found that are like it; the second and later ones of equal rows have the
    spans ``later``."""
    names = own.columns
    kind = found.schema["later"].dataType
    rows = own.select("*", F.lit(None).cast(kind).alias("span"), F.lit(None).cast(kind).alias("later"), F.lit(1).cast("long").alias("n")).unionByName(found.withColumn("n", F.lit(0).cast("long")))
    its = rows.groupBy(*names).agg(F.sum("n").alias("n"), *[F.sort_array(F.array_distinct(F.collect_list(c))).cast(SPANS).alias(c) for c in ("span", "later")])
    its = its.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return its.select(F.col(names[-2]).alias("id"), F.when(F.col("copy") > 1, F.col("later")).otherwise(F.col("span")).alias("duplicates"))


def visited(n: int, stride: int) -> list[int]:
    """Starts of the n-grams that are looked at: the first, and from the second on one every ``stride``."""
    return [0, *range(1, n, max(stride, 1))] if n > 0 else []


def paragraph_ngrams(text: str, length: int, stride: int, separator: str = "\n") -> list[tuple[int, int, int, list[str]]]:
    """(start, end, words, n-grams) of each paragraph; an n-gram is its words joined by blanks."""
    from .python_taggers import word_segments

    out, at = [], 0
    for body in text.split(separator):
        words = word_segments(body)
        grams = [" ".join(words[k : k + length]) for k in visited(len(words) - length + 1, stride)]
        out.append((at, at + len(body), len(words), grams))
        at += len(body) + 1
    return out


#: Groups by hash, in each of which repeats are looked for by themselves; characters of the texts that are cut together.
_GROUPS, _CHUNK = 1024, 1 << 23
_KEY = np.dtype([("a", "<u8"), ("b", "<u4")])


def _digests(texts: list[str]) -> np.ndarray:
    """Two numbers of 64 bits for each text."""
    return np.frombuffer(b"".join(hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts), np.uint64).reshape(-1, 2)


def _hashed_grams(texts: list[str | None], length: int, stride: int, separator: str, skip_short: bool, compared):
    """(document, number, start, end, n-grams) of each paragraph as arrays, and the hashes of all n-grams in order.

    An n-gram's hash comes from those of its words; a whole paragraph that reads like an n-gram has the n-gram's.
    """
    from .python_taggers import word_segments

    numbers: dict[str, int] = {}
    words: list[int] = []
    firsts: list[np.ndarray] = []  # of each n-gram, its first word among all
    parts, bodies, places, total = [], [], [], 0
    later = np.arange(0)
    for d, text in enumerate(texts):
        at = 0
        for k, body in enumerate((text or "").split(separator)):
            many = 0
            if compared(body):
                its = word_segments(body)
                n = len(its) - length + 1
                many = 1 + len(range(1, n, max(stride, 1))) if n > 0 else 0
                if many < 2:
                    its, many = body.split(" "), 0 if skip_short or not body else 1
                    if many and not (len(its) == length and all(its)):
                        bodies.append(body)
                        places.append(total)
                        its = [""] * length
                if many:
                    if len(later) < many:
                        later = np.concatenate([[0], np.arange(1, 2 * many * max(stride, 1) + 1, max(stride, 1))])
                    firsts.append(later[:many] + len(words))
                    words += [numbers.setdefault(w, len(numbers)) for w in its]
            parts.append((d, k, at, at + len(body), many))
            total += many
            at += len(body) + 1
    keys = np.zeros(total, _KEY)
    if total:
        hashes, its, at = _digests(list(numbers)), np.array(words), np.concatenate(firsts)
        two = np.zeros((total, 2), np.uint64)
        for k in range(length):
            two += hashes[its[at + k]] * np.array([pow(m, 2 * k + 1, 1 << 64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)], np.uint64)
        if bodies:
            two[places] = _digests(bodies)
        two ^= two >> np.uint64(32)
        two *= np.uint64(0xD6E8FEB86659FD93)
        keys["a"], keys["b"] = two[:, 0], two[:, 1] >> np.uint64(32)
    return np.array(parts, np.int64).reshape(-1, 5), keys


def _by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether a key is another than the one before it): places sorted by key, those of equal keys as they come."""
    by = np.argsort(keys["a"], kind="stable")
    a, b = keys["a"][by], keys["b"][by]
    new = np.ones(len(by), bool)
    new[1:] = a[1:] != a[:-1]
    if (b[1:] != b[:-1])[~new[1:]].any():  # keys that half their bits tell apart
        by = np.lexsort((keys["b"], keys["a"]))
        a, b = keys["a"][by], keys["b"][by]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return by, new


def _lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _in_order(table: pa.Table, names: list[str]) -> np.ndarray:
    return pc.sort_indices(table, sort_keys=[(n, "ascending") for n in names], null_placement="at_end").to_numpy()


def dedupe_ngrams(docs: DataFrame, ngram_length: int, stride: int = 0, threshold: float = 1.0, skip_short: bool = False, min_length: int = 0, min_words: int = 0, skip_empty: bool = False, text_col: str = "text", id_col: str = "id", order_by: list[str] | None = None, separator: str = "\n", seeds: DataFrame | None = None, read_only: bool = False) -> DataFrame:
    """(id, duplicates) of every document: paragraphs of whose n-grams at least the share ``threshold`` occurred before.

    A paragraph of fewer than two n-grams counts as one n-gram, its whole text, unless ``skip_short``.  Paragraphs under ``min_length`` characters
    or ``min_words`` words, and with ``skip_empty`` blank ones, are left out.  Occurrences are
    ordered by document, paragraph and place; the n-grams of seeds (text) all came before.  Documents that tie in order come as in dedupe_paragraphs.

    Of each n-gram of a chunk of documents the first occurrence alone is shuffled, as a hash of 96 bits with its place, packed with others of its
    group; the rest are repeats already.  What is found comes together by paragraph.
    """
    own = _own(docs, text_col, id_col, order_by)
    names = [f"u{i}" for i in range(len(own))]
    own[-1] = F.hash(docs[text_col]).alias(names[-1])  # shorter, as it goes with each n-gram
    rows = docs.select(*own, docs[text_col].alias("text"), F.lit(False).alias("seed"))
    kinds = {f.name: f.dataType for f in rows.schema if f.name in names}
    if seeds is not None:
        rows = rows.unionByName(seeds.select(*[F.lit(None).cast(t).alias(n) for n, t in kinds.items()], F.col(seeds.columns[0]).alias("text"), F.lit(True).alias("seed")))

    def compared(body: str) -> bool:
        return len(body) >= min_length and not (skip_empty and not body.strip()) and not (min_words and len(body.split()) < min_words)

    def blocks(chunk: pa.RecordBatch, seed: bool) -> Iterator[pa.RecordBatch]:
        chunk = chunk.take(pa.array(_in_order(pa.table(chunk.select(names)), names)))
        parts, keys = _hashed_grams(chunk["text"].to_pylist(), ngram_length, stride, separator, skip_short, compared)
        part = np.repeat(np.arange(len(parts)), parts[:, 4])
        hits = np.zeros(len(parts), np.int64)
        if not read_only or seed:
            by, new = _by_key(keys)
            first = by[new]
            again = np.ones(len(keys), bool)
            again[first] = False
            hits = np.bincount(part[again], minlength=len(parts))
            first.sort()
            keys, part = keys[first], part[first]
        empty = pa.nulls(0, pa.int64())
        if not seed:
            doc = np.flatnonzero(np.diff(parts[:, 0], append=-1)) + 1  # ends of documents
            table = np.column_stack([parts[:, 1:], hits])
            group = chunk[names[-1]].to_numpy() % _GROUPS
            columns = [_lists(chunk[n], np.arange(1, chunk.num_rows + 1)) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.nulls(len(group), pa.binary()), pa.nulls(len(group), pa.binary()), pa.array(np.zeros(len(group), bool)), *columns, _lists(pa.array(table.ravel()), doc * 5)], ["g", "keys", "pos", "seed", *names, "parts"])
        group = (keys["a"] % np.uint64(_GROUPS)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        keys, part, group = keys[order], part[order], group[order]
        ends = np.flatnonzero(np.diff(group, append=-1)) + 1
        n = len(ends)
        of = pa.array(parts[part, 0]) if not seed else empty
        columns = [_lists(chunk[c].take(of), ends if not seed else np.zeros(n, int)) for c in names]
        yield pa.RecordBatch.from_arrays([pa.array(group[ends - 1], pa.int32()), _bytes(keys, ends), _bytes(parts[part, 1].astype(np.uint32), ends), pa.array(np.full(n, seed)), *columns, _lists(empty, np.zeros(n, int))], ["g", "keys", "pos", "seed", *names, "parts"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.utf8_length(batch["text"]).fill_null(0).to_numpy(zero_copy_only=False)) // _CHUNK
            seed = batch["seed"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(size, prepend=-1) | np.diff(seed.astype(int), prepend=-1))
            for at, to in zip(cuts, [*cuts[1:], batch.num_rows]):
                yield from blocks(batch.slice(at, to - at), bool(seed[at]))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        whole = table.filter(pc.is_null(table["keys"]))
        columns = [[pc.list_flatten(whole[n]).combine_chunks() for n in names], None]
        five = pc.list_flatten(whole["parts"]).to_numpy().reshape(-1, 5)
        of = pa.array(np.repeat(np.arange(whole.num_rows), pc.list_value_length(whole["parts"]).to_numpy() // 5))
        out = [pa.table([*[c.take(of) for c in columns[0]], *[pa.array(five[:, k]) for k in range(5)], pa.array(np.ones(len(five), np.int64))], out_names)]
        packed = table.filter(pc.is_valid(table["keys"]))
        if packed.num_rows:
            keys = [np.frombuffer(x, _KEY) for x in packed["keys"].to_pylist()]
            seed = np.repeat(packed["seed"].to_numpy(), [len(k) for k in keys])
            keys = np.concatenate(keys)
            pos = np.frombuffer(b"".join(packed["pos"].to_pylist()), np.uint32)
            by, new = _by_key(keys)
            number = np.empty(len(by), np.int64)
            number[by] = np.cumsum(new) - 1
            known = np.zeros(number.max() + 1, bool)
            known[number[seed]] = True
            number, pos = number[~seed], pos[~seed]  # of the documents' own, whose places the lists have
            its = np.flatnonzero(known[number] if read_only else known[number] | (np.bincount(number, minlength=len(known)) > 1)[number])
            found = pa.table([pc.list_flatten(packed[n]).combine_chunks().take(pa.array(its)) for n in names] + [pa.array(pos[its].astype(np.int64))], [*names, "pos"])
            number = number[its]
            hit = known[number]
            if not read_only and len(its):
                order = _in_order(found, [*names, "pos"])
                hit = hit.copy()
                later = np.ones(len(order), bool)
                later[np.unique(number[order], return_index=True)[1]] = False
                hit[order[later]] = True
            found = found.filter(pa.array(hit)).group_by([*names, "pos"]).aggregate([([], "count_all")])
            none = pa.nulls(found.num_rows, pa.int64())
            out.append(pa.table([*[found[n] for n in names], found["pos"], none, none, none, found["count_all"], pa.array(np.zeros(found.num_rows, np.int64))], out_names))
        return pa.concat_tables(out)

    out_names = [*names, "pos", "start", "end", "total", "hits", "n"]
    binary, long = T.BinaryType(), T.LongType()
    packed = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("keys", binary), T.StructField("pos", binary), T.StructField("seed", T.BooleanType()), *[T.StructField(n, T.ArrayType(t)) for n, t in kinds.items()], T.StructField("parts", T.ArrayType(long))])
    found = T.StructType([T.StructField(n, kinds.get(n, long)) for n in out_names])
    rows = rows.mapInArrow(cut, packed).groupBy("g").applyInArrow(search, found)
    rows = rows.groupBy(*names, "pos").agg(*[F.max(c).alias(c) for c in ("start", "end", "total")], *[F.sum(c).alias(c) for c in ("hits", "n")]).where("hits > 0 OR pos = 0")
    # of n equal documents all but one have been seen before as a whole, unless seeds alone are compared
    once = F.col("hits") / F.col("n") if read_only else F.col("hits") - (F.col("n") - 1) * F.col("total")

    def span(hits: Column) -> Column:
        score = (hits / F.col("total")).cast("float")
        return F.when((F.col("total") > 0) & (score >= F.lit(threshold).cast("float")) & (score > 0), F.struct("start", "end", score.cast("double").alias("score")))

    its = rows.groupBy(*names).agg(F.max("n").alias("n"), *[F.sort_array(F.collect_list(span(h))).cast(SPANS).alias(c) for c, h in (("span", once), ("later", once if read_only else F.col("total")))])
    its = its.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return its.select(F.col(names[-2]).alias("id"), F.when(F.col("copy") > 1, F.col("later")).otherwise(F.col("span")).alias("duplicates"))


def bloom_size(expected: int, false_positive_rate: float, least_bytes: int = 1 << 20) -> tuple[int, int]:
    """(bytes, hashes) of a Bloom filter: the size doubles from ``least_bytes`` until the rate is reached.

    For planning beside other tools; the operators here are exact and need none.
    """
    size = least_bytes
    while True:
        hashes = max(1, math.ceil(size * 8 / max(expected, 1) * math.log(2)))
        if (1 - math.exp(-hashes * expected / (size * 8))) ** hashes <= false_positive_rate:
            return size, hashes
        size *= 2


def remove_spans(docs: DataFrame, spans: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """docs with the duplicates cut out of their texts."""
    from ..functions.spans import replace_spans

    joined = docs.join(spans.select(F.col("id").alias("_id"), "duplicates"), docs[id_col] == F.col("_id"), "left")
    return joined.withColumn(text_col, replace_spans(F.col(text_col), F.coalesce("duplicates", F.array().cast(SPANS)), "")).select(*docs.columns)
