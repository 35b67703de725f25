"""Benchmark decontamination: pieces of test items found exactly, then verified by bit-parallel edit distance."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col

#: Edits that a copy of an item may hold, as a share of the item's characters.
ERROR_RATE = 0.1
#: Characters of an item's normal form from which it is searched.  Items of a word or two occur by chance in clean documents; whoever has such
#: items and doesn't want them found may raise it.
LEAST_CHARS = 1
#: Characters of items that one automaton holds; more are searched in several passes.
SLICE_CHARS = 4_000_000

SCHEMA = "doc_id long, item_id long, start long, stop long, distance long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def normal(text: str) -> str:
    """Lower case, with one blank for each run of white space."""
    return " ".join(text.lower().split())


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(eq: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of a pattern of m characters in the text, the first of those that tie; None if over ``most``."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end, get = full, 0, m, most + 1, -1, eq.get
    for j, c in enumerate(text):
        e = get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return (best, end) if end >= 0 else None


class Node:
    """A part of an item that is to occur with at most ``budget`` edits if both its halves miss theirs; leaves occur exactly."""

    __slots__ = ("parent", "start", "stop", "budget", "eq", "probes")

    def __init__(self, parent: Node | None, start: int, stop: int, budget: int):
        self.parent, self.start, self.stop, self.budget = parent, start, stop, budget
        self.eq: dict[str, int] | None = None
        #: For a leaf: parts of the rest of its parent of which one occurs exactly if the parent does within its budget.
        self.probes: tuple[str, ...] = ()


def tree(text: str, budget: int) -> list[Node]:
    """The budget + 1 leaves of an item's tree.  Of a node with k edits one half has at most its share of k - 1, so a leaf with none."""
    leaves: list[Node] = []

    def split(node: Node) -> None:
        if not node.budget:
            leaves.append(node)
            return
        left = (node.budget - 1) // 2
        right = node.budget - 1 - left
        at = node.start + (node.stop - node.start) * (left + 1) // (left + right + 2)
        split(Node(node, node.start, at, left))
        split(Node(node, at, node.stop, right))

    split(Node(None, 0, len(text), budget))
    for leaf in leaves:
        if up := leaf.parent:
            rest = text[leaf.stop : up.stop] if leaf.start == up.start else text[up.start : leaf.start]
            cuts = [len(rest) * i // (up.budget + 1) for i in range(up.budget + 2)]
            leaf.probes = tuple(rest[a:b] for a, b in zip(cuts, cuts[1:]))
    return leaves


class Searcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS):
        import ahocorasick

        self.automaton, self.items = ahocorasick.Automaton(), []
        by: dict[str, list[tuple[int, Node]]] = {}
        for item_id, raw in items:
            text = normal(raw)
            if len(text) >= least_chars:
                for leaf in tree(text, int(error_rate * len(text))):
                    by.setdefault(text[leaf.start : leaf.stop], []).append((len(self.items), leaf))
                self.items.append((item_id, text, int(error_rate * len(text))))
        for piece, where in by.items():
            self.automaton.add_word(piece, (len(piece), where))
        if by:
            self.automaton.make_automaton()

    def search(self, raw: str, first_only: bool = False) -> dict[int, tuple[int, int, int]]:
        """Item's number: (distance, start, stop) of its best place in the text's normal form; the first of those that tie.

        Every hit of a piece whose climb succeeds opens a region that holds each place of the item within its budget around the hit; later
        hits in it widen it without a climb of their own.  The best place is then looked for in each region once.
        """
        found: dict[int, tuple[int, int, int]] = {}
        if not self.items or not raw:
            return found
        text = normal(raw)
        regions: dict[int, list[list[int]]] = {}
        for last, (size, where) in self.automaton.iter(text):
            at = last + 1 - size
            for i, leaf in where:
                origin, budget = at - leaf.start, self.items[i][2]
                lo, hi = origin - budget, origin + len(self.items[i][1]) + budget
                open_ = regions.get(i)
                if open_ and lo <= open_[-1][1]:
                    # hits come by their ends, so only the last region can still grow
                    open_[-1][0], open_[-1][1] = min(open_[-1][0], lo), max(open_[-1][1], hi)
                    continue
                up = leaf.parent
                if up is not None:
                    first = origin + up.start - up.budget
                    near = text[first if first > 0 else 0 : origin + up.stop + up.budget]
                    if not any(p in near for p in leaf.probes):
                        continue
                if self._climbs(text, i, leaf, origin):
                    if first_only:
                        return {i: (0, 0, 0)}
                    regions.setdefault(i, []).append([lo, hi])
        for i, its in regions.items():
            found[i] = min(self._best(text, i, max(0, lo), hi) for lo, hi in its)
        return found

    def _climbs(self, text: str, i: int, leaf: Node, origin: int) -> bool:
        """Whether each node from a leaf up to the whole item is within its budget around the place that the leaf gives."""
        item = self.items[i][1]
        node = leaf.parent
        while node is not None:
            if node.eq is None:
                node.eq = masks(item[node.start : node.stop])
            region = text[max(0, origin + node.start - node.budget) : max(0, origin + node.stop + node.budget)]
            if myers(node.eq, node.stop - node.start, region, node.budget) is None:
                return False
            node = node.parent
        return True

    def _best(self, text: str, i: int, lo: int, hi: int) -> tuple[int, int, int]:
        _, item, budget = self.items[i]
        region = text[lo:hi]
        distance, end = myers(masks(item), len(item), region, budget)
        back = myers(masks(item[::-1]), len(item), region[:end][::-1], distance)
        return distance, lo + end - (back[1] if back else end), lo + end


_SEARCHERS: dict[str, Searcher] = {}


def _searcher(key: str, shared, error_rate: float, least_chars: int) -> Searcher:
    """The searcher of a broadcast, built once in each worker process."""
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = Searcher(shared.value, error_rate, least_chars)
    return _SEARCHERS[key]


def slices(items: DataFrame, id_col: str = "item_id", text_col: str = "text", slice_chars: int = SLICE_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, in lists of about ``slice_chars`` characters at most: a single list unless the benchmark is huge."""
    rows = items.select(col(items, id_col).cast("long").alias("id"), col(items, text_col).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(1, -(-total // slice_chars))
    for k in range(many):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(many)) == k) if many > 1 else rows
        yield [(r["id"], r["text"]) for r in part.orderBy(F.col("id").asc_nulls_last(), "text").collect()]


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, item_id, start, stop, distance) of every item that a document holds: its best place, in the document's normal form.

    Documents and items are lower-cased and their white space is made single blanks.  An item of m characters may occur with
    k = error_rate * m edits.  It is split into k + 1 pieces, of which one at least occurs exactly wherever the item does; one
    automaton finds those of all items in one pass over the whole text.  A hit is verified by Myers' bit-parallel distance, from
    the smallest part with a budget of its own up to the whole item, so chance hits end early.  No document is shuffled.

    Edge cases: null and empty documents and items match nothing.  Items under ten characters occur exactly or not at all, wherever they stand;
    ``least_chars`` leaves out shorter ones.  Rows with null or repeated ids, and repeated items, are matched like any other.  Of places that
    tie the first is given.  Texts are searched whole, however long.  An empty benchmark gives no rows.  Other columns aren't read.
    """
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text")).where(F.col("text") != "")
    out = None
    for part in slices(items, text_col=text_col, slice_chars=slice_chars):
        shared = docs.sparkSession.sparkContext.broadcast(part)  # slice_chars bounds it

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(key, shared, error_rate, least_chars)
            for batch in batches:
                at, found = [], []
                for r, text in enumerate(batch.column(1).to_pylist()):
                    for i, (distance, start, stop) in sorted(searcher.search(text).items()):
                        at.append(r)
                        found.append((searcher.items[i][0], start, stop, distance))
                rest = zip(*found) if found else ([],) * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in rest)], schema=_ARROW)

        some = rows.mapInArrow(run, SCHEMA)
        out = some if out is None else out.union(some)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS, text_col: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """docs without those that hold an item as matches() finds it; the same columns, and no shuffle.  Null texts stay."""
    out = docs
    for part in slices(items, slice_chars=slice_chars):
        out = out.where(~_holds(docs.sparkSession, part, error_rate, least_chars)(col(out, text_col)))
    return out


def _holds(spark: SparkSession, part: list[tuple[int, str]], error_rate: float, least_chars: int):
    """A column function: whether a text holds one of the items."""
    shared, key = spark.sparkContext.broadcast(part), uuid.uuid4().hex  # slice_chars bounds it

    def holds(texts: pa.Array) -> pa.Array:
        searcher = _searcher(key, shared, error_rate, least_chars)
        return pa.array([bool(searcher.search(t or "", True)) for t in texts.to_pylist()], pa.bool_())

    holds.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(holds, "boolean").asNondeterministic()  # so that it runs once a row


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
