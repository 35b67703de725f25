"""Near-duplicate documents: SimHash signatures searched by a forest of tries over permuted bits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import NO_ID, col, doc_key, fresh, materialize, partitions

#: Bits of a signature, and differing bits up to which two documents are near duplicates.
BITS, MOST_BITS = 256, 50
#: Chance with which the forest finds a pair that differs in MOST_BITS bits; nearer pairs are found with higher ones.
RECALL = 0.95
#: Signatures that a leaf of full depth holds on average at most: it sets the depth, and the depth the number of trees.
LEAF = 64
#: Signatures of a trie's node up to which it isn't split further on the way down to the full depth, and the levels that this begins above it.
NODE, CLIMB = 48, 4
#: Signatures of a leaf up to which one task searches it; larger ones are searched in blocks of so many.
BLOCK = 1 << 18
#: Rows that every block of a large leaf holds, so that its blocks' components meet.
LEADERS = 32
#: Large leaves that are told to all tasks; were there more, BLOCK would be doubled until there aren't.
MOST_LARGE = 1 << 20
#: Rows of a large leaf that are compared with the others at once.
_STRIDE = 16

_WORDS = BITS // 64
#: Columns of a signature: its bits.
_SIG = [f"s{i}" for i in range(_WORDS)]


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 4): the signature over the distinct words of each text, each word with one vote a bit; and which rows have a word at all.
    In scripts without blanks pairs of neighbouring characters stand for words."""
    out, some = np.zeros((len(texts), _WORDS), np.uint64), np.zeros(len(texts), bool)
    for first, part in tb.chunks(texts, 1 << 19):
        data, offs = tb.buffers(part)
        start, end, row = tb.terms(data, offs)
        if not len(row):
            continue
        h = tb.span_hash(tb.prefix(data), start, end)
        # distinct words of a row: equal hashes come together when sorted by (row, hash); 40 bits of hash beside 24 of row
        key = np.unique((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        row, word = (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)
        cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        n = np.diff(np.concatenate([cuts, [len(row)]]))
        votes = np.empty((len(cuts), BITS), np.int64)
        for w in range(_WORDS):
            x = tb.mix(word + np.uint64((w + 1) * 0x5851F42D4C957F2D & ((1 << 63) - 1)))
            votes[:, 64 * w : 64 * w + 64] = _bit_counts(x, cuts, n)
        # a tie of votes is broken by the bit's parity, so that no text leans to ones
        ones = 2 * votes + (np.arange(BITS) & 1) > n[:, None]
        out[first + row[cuts]] = np.packbits(ones.reshape(-1, _WORDS, 64), axis=2, bitorder="little").view(np.uint64)[:, :, 0]
        some[first + row[cuts]] = True
    return out, some


def _bit_counts(x: np.ndarray, cuts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of x[cut:cut + n] have each of the 64 bits set.

    Eight bytes a word at a time: bit b of all eight bytes is added as eight byte-wide counters in one 64-bit number, in runs of
    up to 255 words so that no counter overflows.
    """
    runs = np.repeat(cuts, -(-n // 255)) + _within(-(-n // 255)) * 255
    owner = np.repeat(np.arange(len(cuts)), -(-n // 255))
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    out = np.empty((len(cuts), 8, 8), np.int64)
    for b in range(8):
        sums = np.add.reduceat((x >> np.uint64(b)) & np.uint64(0x0101010101010101), runs)
        out[:, :, b] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out.reshape(len(cuts), 64)


def _within(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the given numbers."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def chance(depth: int, differing: int) -> float:
    """That two signatures which differ in so many bits agree in ``depth`` bits drawn without replacement."""
    return math.prod((BITS - differing - i) / (BITS - i) for i in range(depth))


def shape(docs: int, recall: float = RECALL, differing: int = MOST_BITS) -> tuple[int, int]:
    """(trees, depth) for so many signatures.

    The depth is where density puts it: a leaf of full depth holds LEAF signatures at most on average, however many there are.  The
    trees are as many as reach the recall at that depth; their number grows as the 0.31th power of that of the signatures.
    """
    depth = min(60, max(1, math.ceil(math.log2(max(docs, 2) / LEAF))))
    return math.ceil(math.log(1 - recall) / math.log1p(-chance(depth, differing))), depth


def permutation(tree: int) -> np.ndarray:
    """The bits that a tree reads, the first at its root."""
    return np.random.default_rng(1000 + tree).permutation(BITS)[:64]


def tree_keys(sig: np.ndarray, tree: int, bits: int = 64) -> np.ndarray:
    """The first permuted bits at the head of a number of 64, so that order and common prefixes are those of the trie."""
    key = np.zeros(len(sig), np.uint64)
    for bit in permutation(tree)[:bits]:
        key = (key << np.uint64(1)) | ((sig[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1))
    return key << np.uint64(64 - bits) if bits < 64 else key


def near(a: np.ndarray, b: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Whether the whole signatures differ in ``most`` bits at most."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= most


def leaves(keys: np.ndarray, top: int, depth: int, node: int = NODE) -> np.ndarray:
    """Begins of the leaves of a trie over sorted keys: nodes at level ``top`` are split bit by bit while they hold more than
    ``node`` keys and are above ``depth``."""
    cuts = np.concatenate([[0], np.flatnonzero((keys[1:] ^ keys[:-1]) >> np.uint64(64 - top)) + 1]) if len(keys) else np.zeros(0, np.int64)
    for level in range(top + 1, depth + 1):
        size = np.diff(np.concatenate([cuts, [len(keys)]]))
        big = np.repeat(size > node, size)
        split = np.flatnonzero(((keys[1:] ^ keys[:-1]) >> np.uint64(64 - level) != 0) & big[1:]) + 1
        cuts = np.union1d(cuts, split)
    return cuts


def node_edges(sig: np.ndarray, cuts: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join, within each leaf, all rows that chains of pairs of ``most`` differing bits at most join.

    Every pair of a leaf is compared, except that in large leaves rows of one component aren't compared once they have joined it.
    """
    n = len(sig)
    size = np.diff(np.concatenate([cuts, [n]]))
    stop = np.repeat(cuts + size, size)
    large = size > 4 * NODE
    a, b = [], []
    small = np.repeat(~large, size)
    at = np.flatnonzero(small)
    shift = 1
    while len(at := at[at + shift < stop[at]]):
        close = at[near(sig[at], sig[at + shift], most)]
        a.append(close)
        b.append(close + shift)
        shift += 1
    for k in np.flatnonzero(large):
        left, queue, wave = np.arange(cuts[k], cuts[k] + size[k]), np.zeros(0, np.int64), _Wave()
        while len(left) or len(queue):
            if len(queue):
                block, queue = queue[:_STRIDE], queue[_STRIDE:]
            else:
                wave.close(sig, most, a, b)
                block, left = left[:_STRIDE], left[_STRIDE:]
                i, j = _close(sig, block, block, most)
                wave.add(block, block[i[i < j]], block[j[i < j]])
            i, j = _close(sig, block, left, most)
            if len(i):
                joined = np.zeros(len(left), bool)
                joined[j] = True
                wave.add(left[joined], block[i], left[j])
                queue = np.concatenate([queue, left[joined]])
                left = left[~joined]
        wave.close(sig, most, a, b)
    return (np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)) if a else (np.zeros(0, np.int64),) * 2


class _Wave:
    """The rows that a block of first rows led to, and the pairs that joined them."""

    def __init__(self) -> None:
        self.rows: list[np.ndarray] = []
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def add(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        self.rows.append(rows)
        self.a.append(a)
        self.b.append(b)

    def close(self, sig: np.ndarray, most: int, a: list[np.ndarray], b: list[np.ndarray]) -> None:
        """Hands over the pairs, and those that join the wave's components to each other: rows beside its largest component are compared with all of it."""
        if not self.rows:
            return
        rows = np.concatenate(self.rows)
        order = np.argsort(rows)
        place = lambda x: order[np.searchsorted(rows[order], x)]
        moved, least = spanning(rows, place(np.concatenate(self.a)), place(np.concatenate(self.b)))
        a.append(moved)
        b.append(least)
        root = rows.copy()
        root[place(moved)] = least
        names, which, many = np.unique(root, return_inverse=True, return_counts=True)
        if len(rows) > _STRIDE and len(names) > 1:
            rest = np.flatnonzero(which != many.argmax())
            for at in range(0, len(rest), _STRIDE):
                part = rest[at : at + _STRIDE]
                i, j = _close(sig, rows[part], rows, most)
                pairs = np.unique(np.stack([which[part[i]], which[j]], 1)[which[part[i]] != which[j]], axis=0)
                a.append(names[pairs[:, 0]])
                b.append(names[pairs[:, 1]])
        self.__init__()


def _close(sig: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all near pairs of rows a[i] and b[j]; half of the bits rule out most others."""
    x, y = sig[a], sig[b]
    some = np.zeros((len(a), len(b)), np.uint8)
    for w in range(_WORDS // 2):
        some += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    i, j = np.nonzero(some <= most)
    ok = near(x[i], y[j], most)
    return i[ok], j[ok]


def spanning(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its component) of each id that isn't the least, for edges between positions of ids."""
    names, local = np.unique(ids, return_inverse=True)
    a, b = local[a], local[b]
    label = np.arange(len(names))
    while True:
        old = label
        label = label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, old[a])
        label = label[label]
        if (label == old).all():
            break
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_ROW = "did long, " + ", ".join(f"{s} long" for s in _SIG)


def _signature(part: pa.RecordBatch) -> np.ndarray:
    return np.stack([part.column(s).to_numpy().view(np.uint64) for s in _SIG], 1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 4096):
            yield batch.slice(lo, 4096)


def _groups(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.Table]:
    """Batches sorted by their first column as tables of about ``least`` rows that hold each value's rows together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        # what comes before the last value of a batch is complete
        node = batch.column(0).to_numpy()
        cut = int(np.searchsorted(node, node[-1])) if len(node) else 0
        if cut or not held:
            held.append(batch.slice(0, cut))
            if sum(map(len, held)) >= least:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(cut))
        else:
            held.append(batch)
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def _edges(ids: np.ndarray, sig: np.ndarray, cuts: np.ndarray, most: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in spanning(ids, *node_edges(sig, cuts, most))], schema=_EDGE)


def _by_node(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), key).sortWithinPartitions(key)


def forest_edges(sigs: DataFrame, many: int, trees: int, depth: int, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): ids joined by the forest, of ``many`` rows sigs (did, s0..s3) with distinct signatures.

    A row travels once for each tree, to the node ``CLIMB`` levels above the full depth, where the node's leaves are found and searched.
    Rows of a leaf of over ``block`` signatures go to large_leaf_edges() instead.
    """
    top = max(1, depth - CLIMB)
    large, block = large_leaves(sigs, many, trees, depth, block)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sig = _signature(part)
            for tree in range(trees):
                keys = tree_keys(sig, tree, depth)
                at = np.flatnonzero(~np.isin(keys >> np.uint64(64 - depth), large[tree])) if tree in large else np.arange(len(part))
                node = (tree << 48) | (keys[at] >> np.uint64(64 - top)).astype(np.int64)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(node), *(c.take(at) for c in part.columns)], ["node", *part.schema.names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            tree = table["node"].to_numpy() >> 48
            sig, ids = _signature(table), table["did"].to_numpy()
            order, cuts = [], []
            for x, y in _ranges(tree):
                keys = tree_keys(sig[x:y], int(tree[x]), depth)
                by_key = np.argsort(keys)
                order.append(by_key + x)
                cuts.append(leaves(keys[by_key], top, depth) + x)
            order = np.concatenate(order)
            yield _edges(ids[order], sig[order], np.concatenate(cuts), most)

    rows = sigs.select("did", *_SIG)
    edges = _by_node(rows.mapInArrow(spread, f"node long, {_ROW}"), "node").mapInArrow(search, "a long, b long")
    return edges.union(large_leaf_edges(rows, large, depth, most, block)) if large else edges


def large_leaves(sigs: DataFrame, many: int, trees: int, depth: int, block: int = BLOCK) -> tuple[dict[int, np.ndarray], int]:
    """The leaves of full depth of over ``block`` signatures as sorted prefixes by tree, and the block size: a plan, which doesn't change what is found.

    Up to ``block`` signatures in all there is none.  Counts are taken on one signature in 16 where a block holds many.
    """
    if many <= block:
        return {}, block
    share = 16 if block >= 1 << 12 else 1
    some = sigs.where(F.pmod(F.xxhash64("did", F.lit(5)), F.lit(share)) == 0) if share > 1 else sigs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sig = _signature(part)
            for tree in range(trees):
                leaf, n = np.unique(tree_keys(sig, tree, depth) >> np.uint64(64 - depth), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), tree, np.int64)), pa.array(leaf.astype(np.int64)), pa.array(n)], ["tree", "leaf", "n"])

    counts = some.select("did", *_SIG).mapInArrow(count, "tree long, leaf long, n long").groupBy("tree", "leaf").agg((F.sum("n") * share).alias("n"))
    counts = materialize(counts.where(F.col("n") > block), "large")
    while counts.where(F.col("n") > block).count() > MOST_LARGE:
        block *= 2
    out: dict[int, list[int]] = {}
    for r in counts.where(F.col("n") > block).select("tree", "leaf").toLocalIterator():  # MOST_LARGE bounds it
        out.setdefault(r["tree"], []).append(r["leaf"])
    return {t: np.sort(np.array(x, np.uint64)) for t, x in out.items()}, block


def large_leaf_edges(rows: DataFrame, large: dict[int, np.ndarray], depth: int, most: int, block: int) -> DataFrame:
    """(a, b): ids joined within leaves that no single task should search, as completely as if one did.

    A leaf's rows are dealt to blocks by a hash of their id, but for a few leaders, which all blocks hold.  Each block is searched as any leaf
    is.  Rows that chains of near pairs within their block join to the first leader are joined to each other.  All others
    then go to every block of the leaf, in batches, to be compared with its rows: near copies of one text leave few such rows.
    """
    spark = rows.sparkSession
    bits = np.uint64(64 - depth)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            sig = _signature(part)
            for tree, its in large.items():
                leaf = tree_keys(sig, tree, depth) >> bits
                at = np.flatnonzero(np.isin(leaf, its))
                name = (tree << 48) | leaf[at].astype(np.int64)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(name), *(c.take(take) for c in part.columns)], ["leaf", *part.schema.names])

    placed = materialize(rows.mapInArrow(spread, f"leaf long, {_ROW}"), "placed")
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min_by("did", F.xxhash64("leaf", "did")).alias("head"))
    # each partition's rows of least hash, then the leaf's: few of each leaf go on
    ranked = placed.select("leaf", "did", F.xxhash64("leaf", "did").alias("h")).groupBy("leaf", F.pmod("h", F.lit(LEADERS)).alias("k")).agg(F.min_by("did", "h").alias("did"))
    sizes = materialize(sizes, "sizes")
    leaders = materialize(ranked.select("leaf", "did").withColumn("leads", F.lit(True)), "leaders")  # LEADERS a leaf, MOST_LARGE leaves
    placed = placed.join(sizes, "leaf").join(leaders, ["leaf", "did"], "left")
    own = F.array(F.pmod(F.xxhash64("did", "leaf", F.lit(3)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("block", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
    placed = materialize(placed.select(F.xxhash64("leaf", "block").alias("node"), "leaf", "block", "blocks", "head", "did", *_SIG), "blocks")
    left_over = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("leaf", pa.int64()), ("did", pa.int64())])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            ids, sig, leaf, head = table["did"].to_numpy(), _signature(table), table["leaf"].to_numpy(), table["head"].to_numpy()
            for x, y in _ranges(table["node"].to_numpy()):
                a, b = node_edges(sig[x:y], np.array([0]), most)
                moved, least = spanning(ids[x:y], a, b)
                root = dict(zip(moved.tolist(), least.tolist()))
                main = root.get(int(head[x]), int(head[x]))
                rest = np.array([i for i in ids[x:y].tolist() if root.get(i, i) != main], np.int64)
                none = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int64()), pa.array(least, pa.int64()), none(len(moved)), none(len(moved))], schema=left_over)
                yield pa.RecordBatch.from_arrays([none(len(rest)), none(len(rest)), pa.array(np.full(len(rest), leaf[x], np.int64)), pa.array(rest)], schema=left_over)

    found = materialize(_by_node(placed, "node").mapInArrow(first, "a long, b long, leaf long, did long"), "found")
    rest = found.where("leaf IS NOT NULL").select("leaf", "did").distinct()
    batches_of = rest.groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    rest = placed.select("leaf", "did", "blocks", *_SIG).dropDuplicates(["leaf", "did"]).join(rest, ["leaf", "did"], "left_semi").join(batches_of, "leaf")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("did", F.lit(7)), F.col("parts")).cast("int"))
    guests = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.xxhash64("leaf", "block", "part").alias("node"), "did", *_SIG)
    hosts = placed.join(batches_of, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.xxhash64("leaf", "block", "part").alias("node"), "did", *_SIG)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            cuts = np.array([x for x, _ in _ranges(table["node"].to_numpy())])
            yield _edges(table["did"].to_numpy(), _signature(table), cuts, most)

    # a guest of its own block is there once
    crossed = _by_node(guests.union(hosts).dropDuplicates(["node", "did"]), "node").mapInArrow(second, "a long, b long")
    return found.where("a IS NOT NULL").select("a", "b").union(crossed)


def _ranges(tree: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(tree[1:] != tree[:-1]) + 1, [len(tree)]])
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def components(edges: DataFrame) -> DataFrame:
    """(did, root): the least id of the component of each id that occurs in edges (a, b).

    Large-star and small-star steps by turns, each a shuffle of the edges, written in the shared folder; a handful of rounds
    joins components of any size, as each halves the longest chain at least.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a node moves to its least neighbour
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour of a node, and the node itself, moves to the least
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        small = materialize(small.where("a <> b"), "edges")
        # stars alone remain when no node is both a leaf and a root, and every leaf has one root
        state = small.groupBy("a").count().agg(F.max("count")).first()[0] or 0
        if state <= 1 and not small.join(small.select(F.col("b").alias("a")).distinct(), "a", "left_semi").take(1):
            return small.select(F.col("a").alias("did"), F.col("b").alias("root"))
        now = small


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, node, did, th, some, s0..s3) of each row, written in the shared folder; node stands for id and text together, uid for the row."""
    kind = pa.struct([("some", pa.bool_()), *((s, pa.int64()) for s in _SIG)])

    def sign(texts: pa.Array) -> pa.Array:
        sig, some = signatures(texts)
        return pa.StructArray.from_arrays([pa.array(some), *(pa.array(np.ascontiguousarray(sig[:, i]).view(np.int64)) for i in range(len(_SIG)))], fields=list(kind))

    sign.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    sign = F.arrow_udf(sign, "some boolean, " + ", ".join(f"{s} long" for s in _SIG)).asNondeterministic()  # so that it runs once a row
    did, text = doc_key(docs, id_col), col(docs, text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.xxhash64(did, text).alias("node"), did.alias("did"), F.xxhash64(text).alias("th"), sign(text).alias("x"))
    return materialize(rows.select("uid", "node", "did", "th", "x.*"), "signatures")


def _clusters(signed: DataFrame, most: int) -> DataFrame:
    """(node, root, first) of the nodes in groups of several: the least id of the group, and whether the node is the one that stays."""
    alive = signed.where("some").select(F.col("node").alias("did"), *_SIG)
    # rows of equal signatures meet first, so that copies cost one row each however many there are
    first = materialize(alive.groupBy(*_SIG).agg(F.min("did").alias("did"), F.max("did").alias("last")), "distinct")
    many = first.count()
    trees, depth = shape(many, differing=most)
    same = alive.join(first.where("did <> last").select(F.col("did").alias("b"), *_SIG), _SIG).select(F.col("did").alias("a"), "b")
    moved = components(forest_edges(first, many, trees, depth, most).union(same))
    members = moved.select(F.col("did").alias("node"), F.col("root").alias("part")).union(moved.select("root", "root").distinct())
    named = signed.where("some").select("node", "did", "th").distinct().join(members, "node")
    least = named.groupBy("part").agg(F.min(F.struct("did", "th", "node")).alias("m"))
    return materialize(named.join(least, "part").select("node", F.col("m.did").alias("root"), (F.col("node") == F.col("m.node")).alias("first")), "groups")


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, keep) of every row of docs: the least id of its group of near duplicates, and whether it is the one that stays.

    A text's signature has a bit for each of 256 hashes: the majority over its distinct lower-cased words.  Documents that differ in
    ``most_bits`` bits at most are near duplicates, and groups are what chains of them join.  Rows of equal signatures are joined by one
    aggregation.  The distinct signatures go into a forest: each tree reads the bits in an order of its own and puts signatures with a common
    prefix together.  Its depth follows density, so that leaves don't grow with the corpus; there are as many trees as find pairs of
    ``most_bits`` differing bits with a chance of 0.95 by the hypergeometric distribution, nearer pairs with more.  Sparse nodes climb four
    levels, dense ones split on the way down.  All pairs of a leaf are verified on the whole signatures, but for pairs that chains of
    others join anyhow; a leaf that many near copies fill is searched in blocks, as completely.  Nothing caps leaves, partners or candidates.

    Edge cases: a text that is null or has no word has no signature, is in no group and stays.  Rows are told apart by id and
    text: those without an id, or that repeat one, are documents of their own by their texts, and of rows alike in both one stays.
    No id sorts last and is null again in the result.  Of a group's rows with the least id the one of the least text hash stays.
    Texts are read whole, however long.  Extra columns aren't read.  No rows give no rows.
    """
    signed = _signed(docs, id_col, text_col)
    roots = _clusters(signed, most_bits)
    alike = _alike(signed).withColumnRenamed("uid", "one")
    rows = signed.select("uid", "node", "did", "some").join(roots, "node", "left").join(alike.select("node", "one"), "node", "left")
    keep = ~F.col("some") | (F.coalesce("first", F.lit(True)) & (F.col("uid") == F.coalesce("one", "uid")))
    real = lambda c: F.when(c != NO_ID, c)
    return rows.select(real(F.col("did")).alias("doc_id"), real(F.coalesce("root", "did")).alias("group_id"), keep.alias("keep"))


def _alike(signed: DataFrame) -> DataFrame:
    """(node, did, th, uid): of rows alike in id and text the first, where there are several."""
    return signed.where("some").groupBy("node", "did", "th").agg(F.min("uid").alias("uid"), F.count("*").alias("n")).where("n > 1").drop("n")


def drop_near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near_duplicates(): the same columns, fewer rows.

    The keys of the rows that go, not of those that stay, meet the texts, in one join.
    """
    signed = _signed(docs, id_col, text_col)
    roots = _clusters(signed, most_bits)
    did, th, gone, alike, every = fresh(docs, "did", "th", "gone", "alike", "every")
    nodes = signed.where("some").select("node", "did", "th").distinct()
    out = nodes.join(roots.where("NOT first"), "node").select("did", "th", F.lit(True).alias("gone"))
    several = _alike(signed).join(roots.where("NOT first").select("node"), "node", "left_anti").select("did", "th", F.lit(False).alias("gone"))
    marked = materialize(out.union(several), "marked").select(F.col("did").alias(did), F.col("th").alias(th), F.col("gone").alias(gone))
    joined = docs.withColumns({did: doc_key(docs, id_col), th: F.xxhash64(col(docs, text_col))}).join(marked, [did, th], "left")
    back = [col(joined, c) for c in docs.columns]
    left = joined.where(F.col(gone).isNull()).select(*back)
    if marked.where(~F.col(gone)).isEmpty():
        return left
    # one of the rows alike in id and text, by an aggregation that combines before its shuffle, as there may be any number of them
    repeated = joined.where(~F.col(gone)).groupBy(did, th).agg(F.first(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(back)])).alias(every))
    return left.union(repeated.select(*[F.col(every)[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near duplicates."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
