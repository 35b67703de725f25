"""Quality rules: hashed n-gram logistic regression, calibrated and held against fixed thresholds."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import col, has_words

#: Labelled rows that the model is fitted on: those with the smallest hashes of their ids.
TRAIN_ROWS = 6000
BITS = 18
CHAR_ORDERS = (3, 5)
#: A document goes if its probability of quality is lower or that of toxicity is higher.
LEAST_QUALITY, MOST_TOXIC = 0.3, 0.5

_SCALE = 50.0
#: Rows of a step of the fit, and steps at least, so that few rows are fitted as well as many.
_BATCH, _STEPS = 64, 250
#: Documents at which a feature's log ratio counts half.
_SHRINK = 12
#: Decay of the weights.
_L2 = 1e-5
_HEADS = 2
#: Tables of weights, and those that each head reads: the case of letters tells of quality but hides toxic words.
_TABLES, _READS = 4, ((0, 1), (2, 3))
#: Whatever is neither an ASCII letter or digit nor beyond ASCII ends a word of the lower-cased text.
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of features (words, their pairs and each order of character n-grams; then the same of the lower-cased text with blanks
    for punctuation): buckets, and the range of each row."""
    for lower, breaks in ((False, tb.SPACE), (True, _BREAK)):
        data, offs = tb.buffers(texts, lower=lower)
        if lower:
            data = np.where(breaks[data], np.uint8(32), data)
        start, end, row = tb.words(data, offs, breaks)
        run = tb.prefix(data)
        h = tb.span_hash(run, start, end)
        lo, hi = np.searchsorted(row, np.arange(len(texts))), np.searchsorted(row, np.arange(len(texts)), "right")
        shift = tb.U64(64 - BITS)
        yield (h >> shift).astype(np.int64), lo, hi
        pairs = tb.mix(h[:-1] * tb.U64(31) + h[1:]) if len(h) else h
        lo = np.minimum(lo, len(pairs))  # a last text without a word begins beyond the last pair
        yield (pairs >> shift).astype(np.int64), lo, np.maximum(lo, hi - 1)
        chars, offs = tb.characters(data, offs)
        for n in CHAR_ORDERS:
            bucket = tb.char_ngrams(run, chars, n, BITS)
            first = np.minimum(offs[:-1], len(bucket))
            yield bucket, first, np.clip(offs[1:] - n, first, len(bucket))


def _table(group: int) -> int:
    """The table of weights of a group: words and pairs share one, character n-grams another, and so for the lower-cased text."""
    lower, group = divmod(group, 2 + len(CHAR_ORDERS))
    return 2 * lower + (group >= 2)


def _norm(many: np.ndarray, head: int) -> np.ndarray:
    """What a head divides counts by: quality is a matter of proportions, toxicity of a few words wherever they are."""
    many = np.maximum(many, 1)
    return many / _SCALE if head == 0 else np.sqrt(many)


class Model:
    """Weights by head, table and bucket; intercepts; slope and offset of each head's calibration."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, slope: np.ndarray, offset: np.ndarray):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margins(self, texts: pa.Array) -> np.ndarray:
        z = np.zeros((len(texts), _HEADS))
        for first, part in tb.chunks(texts, 1 << 19):
            for g, (bucket, lo, hi) in enumerate(_features(part)):
                for head in (h for h in range(_HEADS) if _table(g) in _READS[h]):
                    z[first : first + len(part), head] += tb.row_sums(self.weights[head, _table(g)][bucket], lo, hi) / _norm(hi - lo, head)
        return z + self.bias

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """(rows, 2): of quality and of toxicity."""
        return _sigmoid(self.margins(texts) * self.slope + self.offset)

    def to_bytes(self) -> bytes:
        out, flat = io.BytesIO(), self.weights.reshape(-1)
        at = np.flatnonzero(flat)
        np.savez(out, at=at.astype(np.int32), w=flat[at], bias=self.bias, slope=self.slope, offset=self.offset)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        x = np.load(io.BytesIO(data))
        w = np.zeros((_HEADS, _TABLES, 1 << BITS), np.float32)
        w.reshape(-1)[x["at"]] = x["w"]
        return cls(w, x["bias"], x["slope"], x["offset"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * z + offset) a probability, by Newton's method on smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    if not up or not down:
        return 0.0, float(np.log((up + 1) / (down + 1)))
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([z, np.ones(len(z))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p) - 1e-3 * (beta - [1.0, 0.0]))
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def train(texts: pa.Array, labels: np.ndarray, epochs: int = 10, seed: int = 7) -> Model:
    """Logistic regression by AdaGrad on hashed features; labels has a column for each head.

    Each fourth row is held out to calibrate.  A feature's value is its share of the document (for toxicity its count by the root
    of the document's length) times the log ratio of its document frequencies in the two classes, which keeps
    features that tell nothing near zero.  Both see words, word pairs and character n-grams, for toxicity those of the lower-cased text without punctuation.
    """
    n = len(texts)
    weights = np.zeros((_HEADS, _TABLES, 1 << BITS), np.float32)
    if not n:  # nothing is known: quality 1, toxicity 0
        p = np.array([0.99, 0.01])
        return Model(weights, np.log(p / (1 - p)), np.ones(_HEADS), np.zeros(_HEADS))
    held = np.arange(n) % 4 == 3
    up, down = np.zeros((_HEADS, _TABLES << BITS), np.int32), np.zeros((_HEADS, _TABLES << BITS), np.int32)
    for r, at, _, _ in _entries(texts):  # document frequencies first: most features then need no room
        for head in range(_HEADS):
            for df, which in ((up, labels[:, head] > 0), (down, labels[:, head] <= 0)):
                df[head] += np.bincount(at[which[r] & ~held[r]], minlength=_TABLES << BITS).astype(np.int32)
    ratio = np.stack([_log_ratio(up[h], down[h], labels[~held, h]) for h in range(_HEADS)])
    for head in range(_HEADS):
        for table in set(range(_TABLES)) - set(_READS[head]):
            ratio[head, table << BITS : (table + 1) << BITS] = 0
    # each row's features, numbered among those that the ratios leave, and their values
    names = [np.flatnonzero(x) for x in ratio]
    number = np.zeros(ratio.shape, np.int32)
    for head in range(_HEADS):
        number[head, names[head]] = np.arange(len(names[head]))
    kept: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.zeros(0, np.int32), np.zeros(0, np.float32))] * n for _ in range(_HEADS)]
    for r, at, count, many in _entries(texts):
        for head in range(_HEADS):
            use = np.flatnonzero(ratio[head][at])
            row, feature = r[use], at[use]
            value = (count[use] / _norm(many[use], head) * ratio[head][feature]).astype(np.float32)
            feature = number[head][feature]
            for k, x, y in zip(*(v.tolist() for v in _runs(row))):
                kept[head][k] = feature[x:y].copy(), value[x:y].copy()
    bias = np.zeros(_HEADS)
    for head in range(_HEADS):
        w, bias[head] = _fit_head(kept[head], len(names[head]), labels[:, head], np.flatnonzero(~held), epochs, np.random.default_rng(seed))
        kept[head] = []
        weights[head].reshape(-1)[names[head]] = w * ratio[head][names[head]]
    model = Model(weights, bias, np.ones(_HEADS), np.zeros(_HEADS))
    judge = held if held.any() else ~held  # three rows at most: there is none to hold out
    z = model.margins(texts.filter(pa.array(judge)))
    model.slope, model.offset = (np.array(x) for x in zip(*(_platt(z[:, k], labels[judge, k]) for k in range(_HEADS))))
    return model


def _runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, begin, end) of the runs of equal values."""
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    return row[cuts], cuts, np.append(cuts[1:], len(row)) if len(row) else cuts


def _entries(texts: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, feature, count and number of features of its group, for each feature of each row; rows ascend."""
    for first, part in tb.chunks(texts, 1 << 18):
        keys, counts, sizes = [], [], []
        for g, (bucket, lo, hi) in enumerate(_features(part)):
            many = hi - lo
            row = np.repeat(np.arange(len(part)), many)
            inside = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            key, count = np.unique((row << (BITS + 2)) | (_table(g) << BITS) | bucket[inside], return_counts=True)
            keys.append(key)
            counts.append(count)
            sizes.append(many[key >> (BITS + 2)])
        key, count, size = map(np.concatenate, (keys, counts, sizes))
        order = np.argsort(key >> (BITS + 2), kind="stable")
        key = key[order]
        yield (key >> (BITS + 2)) + first, key & ((4 << BITS) - 1), count[order], size[order]


def _log_ratio(up: np.ndarray, down: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shrunken log ratio of a feature's frequencies in the two classes; 0 for features that are rare or tell little."""
    n = y.sum()
    ratio = np.log((up + 1) / (n + 2)) - np.log((down + 1) / (len(y) - n + 2))
    ratio *= (up + down) / (up + down + _SHRINK)
    return np.where((up + down >= 3) & (np.abs(ratio) > 0.1), ratio, 0).astype(np.float32)


def _fit_head(rows: list[tuple[np.ndarray, np.ndarray]], features: int, y: np.ndarray, fit: np.ndarray, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and intercept."""
    w, square = np.zeros(features, np.float32), np.full(features, 1e-3, np.float32)
    rate = np.clip(y[fit].mean(), 0.01, 0.99)
    bias = float(np.log(rate / (1 - rate)))
    epochs = max(epochs, -(-_STEPS // -(-max(len(fit), 1) // _BATCH)))
    for epoch in range(epochs):
        rng.shuffle(fit)
        for b in range(0, len(fit), _BATCH):
            docs = fit[b : b + _BATCH]
            i, v = (np.concatenate(x) for x in zip(*(rows[d] for d in docs)))
            many = np.array([len(rows[d][0]) for d in docs])
            ends = np.cumsum(many)
            err = (_sigmoid(tb.row_sums(w[i] * v, ends - many, ends) + bias) - y[docs]) / len(docs)
            bias -= 0.3 * float(err.sum())
            g = np.bincount(i, np.repeat(err, many) * v, len(w))
            where = np.flatnonzero(g)
            d = (g[where] + _L2 * w[where]).astype(np.float32)
            square[where] += d * d
            w[where] -= 0.1 / (1 + 2 * epoch / epochs) * d / np.sqrt(square[where])
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the labelled documents, fitted in one task on ``train_rows`` of them at most.

    Labels with a null in id, quality or toxicity are left out, as are texts without a word.  Labels repeated alike count once; of several
    texts of an id the one of the least hash counts, so that no id brings more than a row for each of its labels.  Without labels all
    texts get the probabilities 0.99 and 0.01; with labels of one class alone they get that class's share, whatever their words.
    """
    label = labels.select(col(labels, id_col).cast("long").alias("doc_id"), F.col("quality").cast("int"), F.col("toxic").cast("int")).dropna()
    chosen = label.distinct().orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "quality", "toxic").limit(train_rows)
    texts = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text")).where(has_words(F.col("text")))
    # train_rows bounds the broadcast side
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "quality", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tb.gather(batches, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("quality", pa.int32()), ("toxic", pa.int32())]))
        table = table.append_column("h", pa.array([hash((x, 1)) & 0xFFFFFFFF for x in table["doc_id"].to_pylist()], pa.int64()))
        table = table.sort_by([("h", "ascending"), ("doc_id", "ascending"), ("quality", "ascending"), ("toxic", "ascending"), ("text", "ascending")])
        y = np.stack([table[c].to_numpy() for c in ("quality", "toxic")], 1).astype(np.float64) if len(table) else np.zeros((0, _HEADS))
        yield pa.RecordBatch.from_pydict({"model": pa.array([train(table["text"].combine_chunks().cast(pa.large_string()), y).to_bytes()], pa.binary())})

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return Model.from_bytes(bytes(found["model"])) if found else train(pa.array([], pa.large_string()), np.zeros((0, _HEADS)))


def scorer(spark: SparkSession, model: Model):
    """A column function: text to (quality, toxic), scored in Arrow batches."""
    shared = spark.sparkContext.broadcast(model.to_bytes())  # a few MB at most, whatever the corpus: 2**BITS buckets
    kind = pa.struct([("quality", pa.float64()), ("toxic", pa.float64())])
    cache: dict = {}

    def score(texts: pa.Array) -> pa.Array:
        if "model" not in cache:
            cache["model"] = Model.from_bytes(shared.value)
        if not len(texts):
            return pa.array([], kind)
        p = cache["model"].probabilities(texts)
        return pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], fields=list(kind))

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "quality double, toxic double").asNondeterministic()  # so that it runs once a row


def verdict(p: Column, text: Column) -> Column:
    return F.coalesce(has_words(text) & (p["quality"] >= LEAST_QUALITY) & (p["toxic"] < MOST_TOXIC), F.lit(False))


def quality_rules(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_quality, p_toxic, keep) of every row of docs.

    Edge cases: a text that is null or blank isn't scored: its probabilities are 0 and 0 and it isn't kept.  Rows with null or repeated ids are
    scored like any other, one row out for each in, and texts that are alike alike.  A probability at a threshold keeps for quality and
    rejects for toxicity.  Texts are scored whole, however long.  Columns of docs other than id and text aren't read.  No rows give no rows.
    """
    rows = docs.select(col(docs, id_col).alias("doc_id"), col(docs, text_col).alias("text"))
    scored = rows.select("doc_id", has_words(F.col("text")).alias("some"), scorer(docs.sparkSession, model)("text").alias("p"))
    p_quality, p_toxic = (F.when(F.col("some"), F.col(f"p.{x}")).otherwise(0.0) for x in ("quality", "toxic"))
    scored = scored.select("doc_id", "some", p_quality.alias("p_quality"), p_toxic.alias("p_toxic"))
    return scored.select("doc_id", "p_quality", "p_toxic", (F.col("some") & (F.col("p_quality") >= LEAST_QUALITY) & (F.col("p_toxic") < MOST_TOXIC)).alias("keep"))


def quality_filter(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_rules() keeps, with the same columns."""
    text = col(docs, text_col)
    return docs.where(verdict(scorer(docs.sparkSession, model)(text), text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
