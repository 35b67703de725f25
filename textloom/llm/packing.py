"""Hierarchical packing of documents into windows of several lengths, in balanced steps."""

from __future__ import annotations

import bisect
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, col, materialize
from .tokens import counter, read_vocabulary

#: Context sizes, in tokens.
TIERS = (2048, 8192, 32768)
#: Tokens of windows in a training step.
STEP_TOKENS = 262_144
#: Documents are packed in groups of about so many tokens, each by itself.
GROUP_TOKENS = 1 << 23
#: A token's cost beside attention, in units of the length that attention costs as much again at.
LINEAR = 8192

SCHEMA = "pack long, step long, tier long, window long, place long, doc_id long, doc_start long, n_tokens long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def _best_fit(segments: list[tuple[int, ...]], size: int) -> list[list]:
    """Windows [room, segments] of the segments, which come by falling length: each goes where the least room stays."""
    rooms: list[tuple[int, int]] = []  # (room, window), ascending
    windows: list[list] = []
    for s in segments:
        k = bisect.bisect_left(rooms, (s[0], -1))
        if k < len(rooms):
            _, w = rooms.pop(k)
        else:
            w = len(windows)
            windows.append([size, []])
        windows[w][0] -= s[0]
        windows[w][1].append(s)
        if windows[w][0]:
            bisect.insort(rooms, (windows[w][0], w))
    return windows


def pack(lengths: list[tuple[int, ...]], tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> list[tuple[int, int, int, int, int, int, int]]:
    """(step, tier, window, place, document, first token, tokens) of each segment of the documents (length, order).

    ``order`` is the document's number and breaks ties.  Documents longer than the longest tier are cut into windows of it and a rest.
    """
    tiers = tuple(sorted(tiers))
    pools: list[list[tuple[int, int, int]]] = [[] for _ in tiers]
    for n, order in lengths:
        for start in range(0, n, tiers[-1]):
            size = min(n - start, tiers[-1])
            pools[bisect.bisect_left(tiers, size)].append((size, order, start))
    for pool in pools:
        pool.sort(key=lambda s: (-s[0], s[1], s[2]))
    made: list[tuple[int, list]] = []
    for t in range(len(tiers) - 1, -1, -1):
        windows = _best_fit(pools[t], tiers[t])
        # gaps take the longest segment that fits of the shorter tiers, the next shorter tier first
        rising = [sorted(((s[0], -s[1], -s[2]) for s in pools[k])) for k in range(t)]
        for w in sorted(windows, key=lambda w: (w[0], w[1][0][1:])):
            for k in range(t - 1, -1, -1):
                while w[0] and (at := bisect.bisect_left(rising[k], (w[0] + 1,))):
                    size, order, start = rising[k].pop(at - 1)
                    w[0] -= size
                    w[1].append((size, -order, -start))
        for k in range(t):
            pools[k] = sorted(((size, -order, -start) for size, order, start in rising[k]), key=lambda s: (-s[0], s[1], s[2]))
        made += [(tiers[t], w[1]) for w in windows]
    steps = _steps(made, step_tokens)
    return [(step, size, w, place, order, start, n) for w, ((size, segments), step) in enumerate(zip(made, steps)) for place, (n, order, start) in enumerate(segments)]


def cost(segments: list[tuple[int, ...]]) -> int:
    """What a window takes to train: attention within each segment, and the rest by token."""
    return sum(n * (n + LINEAR) for n, *_ in segments)


def _steps(windows: list[tuple[int, list]], step_tokens: int) -> list[int]:
    """The step of each window: the costliest first, each to the step that costs least so far among those with room."""
    if not windows:
        return []
    step_tokens = max(step_tokens, max(size for size, _ in windows))
    costs = [cost(segments) for _, segments in windows]
    steps = [0] * len(windows)
    many = -(-sum(size for size, _ in windows) // step_tokens)
    heap = [(0, k, step_tokens) for k in range(many)]
    for w in sorted(range(len(windows)), key=lambda w: (-windows[w][0], -costs[w], w)):
        size, full = windows[w][0], []
        while heap and heap[0][2] < size:
            full.append(heapq.heappop(heap))
        spent, k, room = heapq.heappop(heap) if heap else (0, (many := many + 1) - 1, step_tokens)
        steps[w] = k
        heapq.heappush(heap, (spent + costs[w], k, room - size))
        for x in full:
            heapq.heappush(heap, x)
    return steps


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """(doc_id, h, n_tokens, ...) of each row, written in the shared folder; h is a hash of id and text."""
    ranks = read_vocabulary(vocabulary)

    def count(texts: pa.Array) -> pa.Array:
        return counter(ranks).counts(texts)

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    count = F.arrow_udf(count, "long").asNondeterministic()  # so that it runs once a row
    text = col(docs, text_col)
    key = F.xxhash64(F.coalesce(col(docs, id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(text))
    return materialize(docs.select(col(docs, id_col).cast("long").alias("doc_id"), key.alias("h"), count(text).alias("n_tokens"), *more), "tokens")


def packing(docs: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, group_tokens: int = GROUP_TOKENS, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pack, step, tier, window, place, doc_id, doc_start, n_tokens) of every segment.

    Each document goes to the shortest tier that holds it (in windows of the longest and a rest, if none does).  The longest tier is
    packed first, by best fit of falling lengths; what room is left in its windows takes the longest segments that fit from the
    shorter tiers, the next shorter first; then the next tier, with what is left of it.  Windows are dealt to steps of ``step_tokens``,
    each to the step with the least cost so far, so that the steps of a group take about the same time.  Documents meet in groups of about
    ``group_tokens`` by a hash, so the work and memory of a task don't grow with the corpus; (pack, step) names a step.

    Edge cases: documents without a token (null or empty text) have no segment.  Repeated rows are packed as often as they occur.
    A null id stays null.  Equal lengths are taken by rising hash, then id.  Other columns aren't read.
    """
    counted = count_tokens(docs, vocabulary, id_col, text_col)
    return _packed(counted.where("n_tokens > 0"), tiers, step_tokens, group_tokens)


def _packed(counted: DataFrame, tiers: tuple[int, ...], step_tokens: int, group_tokens: int) -> DataFrame:
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    keyed = counted.select(F.pmod("h", F.lit(groups)).alias("pack"), "h", "doc_id", "n_tokens")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("h", "ascending"), ("doc_id", "ascending")])
        rows = pack([(n, i) for i, n in enumerate(table["n_tokens"].to_pylist())], tiers, step_tokens)
        step, tier, window, place, order, start, n = (pa.array(x, pa.int64()) for x in zip(*rows))
        first = table["pack"][0].as_py()
        return pa.Table.from_arrays([pa.array([first] * len(rows), pa.int64()), step, tier, window, place, table["doc_id"].combine_chunks().take(order), start, n], schema=_ARROW)

    return keyed.groupBy("pack").applyInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document, packed."""
    return packing(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
