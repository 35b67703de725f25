"""Language identification by fusing the evidence of text, declared language, address suffix and host."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import col, materialize

#: Labelled rows that the text model is fitted on: those with the smallest hashes of their ids.
TRAIN_ROWS = 6000
BITS = 15
ORDERS = (2, 4)
#: Overlapping n-grams repeat each other's evidence; each counts for so much of an independent one.
TEMPER = 0.25
#: Second-level names under which countries register domains, as in example.co.uk.
_SECOND = "ac|co|com|edu|gob|gouv|gov|go|mil|ne|net|nom|or|org|sch"
#: Pseudo-counts by which a host leans on its domain, a domain on its suffix, a suffix on the corpus.
LEAN = 8.0
#: Pseudo-counts of the table of declared languages and of that of suffixes.
SMOOTH = 2.0
UNKNOWN = "und"


class TextModel:
    """Log-probabilities of hashed byte n-grams by language."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table  # (orders, buckets, languages)

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """(rows, languages): tempered log-likelihoods, the best at 0."""
        out = np.zeros((len(texts), len(self.langs)))
        for first, part in tb.chunks(texts, 1 << 19):
            data, offs = tb.buffers(part)
            for k, n in enumerate(ORDERS):
                bucket = tb.ngrams(data, n, BITS, n)
                lo = np.minimum(offs[:-1], len(bucket))
                hi = np.clip(offs[1:] - n, lo, len(bucket))
                for i in range(len(self.langs)):
                    out[first : first + len(part), i] += tb.row_sums(self.table[k, i][bucket], lo, hi)
        out *= TEMPER
        out -= out.max(1, keepdims=True) if out.shape[1] else 0
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, langs=np.array(self.langs, dtype="U"), table=self.table)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> TextModel:
        x = np.load(io.BytesIO(data))
        return cls([str(v) for v in x["langs"]], x["table"])


def train(texts: pa.Array, labels: list[str]) -> TextModel:
    """Multinomial naive Bayes over hashed byte n-grams of lower-cased text; every n-gram has a pseudo-count of one half."""
    langs = sorted(set(labels))
    at = {x: i for i, x in enumerate(langs)}
    counts = np.full((len(ORDERS), len(langs), 1 << BITS), 0.5)
    which = np.array([at[x] for x in labels], np.int64)
    for first, part in tb.chunks(texts, 1 << 20):
        data, offs = tb.buffers(part)
        for k, n in enumerate(ORDERS):
            bucket = tb.ngrams(data, n, BITS, n)
            lo = np.minimum(offs[:-1], len(bucket))
            hi = np.clip(offs[1:] - n, lo, len(bucket))
            lang = np.repeat(which[first : first + len(part)], hi - lo)
            inside = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            counts[k] += np.bincount(lang << BITS | bucket[inside], minlength=len(langs) << BITS).reshape(len(langs), -1)
    table = np.log(counts / counts.sum(2, keepdims=True))
    return TextModel(langs, (table - table.mean(1, keepdims=True)).astype(np.float32))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """The text model, fitted in one task on ``train_rows`` labelled rows of docs at most.

    Rows with a null or empty text or label are left out; ids may repeat or be null, as rows are chosen by a hash of id and text, and rows
    alike in id, text and label count once.  Without any labelled row no language is known and every text is ``und``.
    """
    rows = docs.select(F.xxhash64(col(docs, id_col).cast("long"), col(docs, text_col), F.lit(13)).alias("h"), col(docs, text_col).alias("text"), F.lower(F.trim(col(docs, lang_col))).alias("lang"))
    rows = rows.where((F.col("text") != "") & (F.col("lang") != "") & (F.col("lang") != UNKNOWN))
    # the bound on hashes comes from hashes alone, so that texts of rows beyond it are never sorted or moved
    bound = rows.select("h").orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    sample = rows.where(F.col("h") <= (bound if bound is not None else 0)).groupBy("h", "lang").agg(F.min("text").alias("text")).select("h", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("text", pa.string()), ("lang", pa.string())])
        table = tb.gather(batches, schema).sort_by([("h", "ascending"), ("lang", "ascending")]).slice(0, train_rows)
        model = train(table["text"].combine_chunks().cast(pa.large_string()), table["lang"].to_pylist())
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.to_bytes()], pa.binary())})

    found = sample.repartition(1).mapInArrow(run, "model binary").first()
    return TextModel.from_bytes(bytes(found["model"])) if found else train(pa.array([], pa.large_string()), [])


def _evidence(spark: SparkSession, model: TextModel):
    shared = spark.sparkContext.broadcast(model.to_bytes())  # 2**BITS numbers for each order and language, whatever the corpus
    cache: dict = {}
    langs = len(model.langs)

    def score(texts: pa.Array) -> pa.Array:
        if "model" not in cache:
            cache["model"] = TextModel.from_bytes(shared.value)
        e = cache["model"].evidence(texts) if len(texts) else np.zeros((0, langs))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * langs, pa.int32()), pa.array(e.reshape(-1)))

    score.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, "array<double>").asNondeterministic()  # so that it runs once a row


def visible_text(html: Column) -> Column:
    """Text between tags, without scripts, styles and comments; entities of letters are left as they are."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")


def domain_of(host: Column) -> Column:
    """The part of a host that is registered: its last two labels, or three under a country's second-level names."""
    three = host.rlike(rf"(?:^|\.)(?:{_SECOND})\.[a-z]{{2}}$")
    return F.when(three, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def page_rows(pages: DataFrame) -> DataFrame:
    """(kind, doc_id, page_id, text, declared, suffix, domain, host) of pages(page_id, url, html)."""
    url, html = col(pages, "url"), col(pages, "html")
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    rows = pages.select(F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), col(pages, "page_id").cast("long").alias("page_id"), visible_text(html).alias("text"), F.when(declared != "", declared).alias("declared"), F.when(host != "", host).alias("host"))
    return rows.select("kind", "doc_id", "page_id", "text", "declared", F.substring_index("host", ".", -1).alias("suffix"), domain_of(F.col("host")).alias("domain"), "host")


def document_rows(docs: DataFrame) -> DataFrame:
    """The same of documents(doc_id, text, source): a source stands for a host; nothing is declared, and there is no address."""
    rows = docs.select(F.lit("document").alias("kind"), col(docs, "doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), col(docs, "text").alias("text"), col(docs, "source").alias("host"))
    none = F.lit(None).cast("string")
    return rows.select("kind", "doc_id", "page_id", "text", none.alias("declared"), none.alias("suffix"), none.alias("domain"), "host")


def _soft(e: str = "e") -> Column:
    """Probabilities from log evidence."""
    p = F.transform(e, lambda x: F.exp(x))
    return F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Expected counts of each language among the rows of each group."""
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias("c"))


def language_fusion(rows: DataFrame, model: TextModel) -> DataFrame:
    """(kind, doc_id, page_id, text_lang, declared, lang, probability) of every row of ``rows``, as page_rows() and document_rows() make them.

    The posterior is the product of four terms, its logarithm their sum.  The text: tempered likelihood of its byte n-grams.
    The declared language: the chance of that declaration given the language, from the corpus's table of expected counts, so that
    a declaration that says little weighs little.  The suffix of the address: likewise.  The host: expected counts of languages among
    the host's *other* rows, smoothed by those of its domain, those by the suffix's, and those by the corpus's.  The
    expected counts all come from one grouped aggregation of the text posteriors by (kind, declared, suffix, domain, host) and are
    rolled up from there.

    Edge cases: a null or empty text has no evidence and leaves the answer to the other terms; a row without any evidence
    gets the corpus's prior.  Null declared, suffix, domain or host: their terms are left out.  A declared language that
    the model doesn't know weighs as its table says.  Of languages that tie the first in alphabetical order wins.
    Repeated rows are counted and answered as often as they occur.  Texts are read whole, however long.  Other columns of the tables aren't
    read.  No rows give no rows.  Without any language known lang is ``und`` and probability 0.
    """
    n = len(model.langs)
    if not n:
        return rows.select("kind", "doc_id", "page_id", F.lit(UNKNOWN).alias("text_lang"), "declared", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("probability"))
    scored = rows.select("kind", "doc_id", "page_id", "declared", "suffix", "domain", "host", _evidence(rows.sparkSession, model)("text").alias("e"))
    scored = materialize(scored, "evidence").withColumn("p", _soft())
    base = materialize(_sums(scored, n, "kind", "declared", "suffix", "domain", "host"), "counts").withColumnRenamed("c", "p")
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    # rates: expected share of languages, each level leaning on the one above
    corpus = _sums(base, n).select(F.transform("c", lambda x: (x + 1.0) / (total(F.col("c")) + n)).alias("prior"))
    up = _sums(base, n, "kind").withColumn("all", F.lit(0)).join(corpus.withColumn("all", F.lit(0)), "all")  # a row for each kind, and one
    lean = lambda c, prior: F.zip_with(c, prior, lambda a, b: (a + LEAN * b) / (total(c) + LEAN))
    up = up.select("kind", lean(F.col("c"), F.col("prior")).alias("prior"))
    suffix = _sums(base, n, "kind", "suffix").join(up, "kind").select("kind", "suffix", lean(F.col("c"), F.col("prior")).alias("prior"))
    domain = _sums(base, n, "kind", "suffix", "domain").alias("d").join(suffix.alias("s"), (F.col("d.kind") == F.col("s.kind")) & F.col("d.suffix").eqNullSafe(F.col("s.suffix")))
    domain = domain.select("d.kind", "d.domain", lean(F.col("d.c"), F.col("s.prior")).alias("prior"))
    host = _sums(base, n, "kind", "domain", "host").alias("h").join(domain.alias("d"), (F.col("h.kind") == F.col("d.kind")) & F.col("h.domain").eqNullSafe(F.col("d.domain")))
    host = host.select("h.kind", "h.host", F.col("h.c").alias("hc"), F.col("d.prior").alias("lean"))

    def given(name: str) -> DataFrame:
        """log P(value | language), for each kind."""
        values = _sums(base.where(F.col(name).isNotNull()), n, "kind", name)
        all_ = values.groupBy("kind").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(n)]).alias("all"), F.count("*").alias("many"))
        return values.join(all_, "kind").select("kind", name, F.zip_with("c", "all", lambda a, b: F.log((a + SMOOTH) / (b + SMOOTH * F.col("many")))).alias(f"log_{name}"))

    x = scored.alias("x").join(host.alias("y"), (F.col("x.kind") == F.col("y.kind")) & F.col("x.host").eqNullSafe(F.col("y.host")), "left").select("x.*", "hc", "lean")
    x = x.join(given("declared"), ["kind", "declared"], "left").join(given("suffix"), ["kind", "suffix"], "left")
    none = F.array(*[F.lit(0.0)] * n)
    others = F.zip_with("hc", "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    x = x.withColumn("others", others)
    host_term = F.zip_with("others", "lean", lambda a, b: F.log((a + LEAN * b) / (total(F.col("others")) + LEAN)))
    x = x.withColumn("prior", F.when(F.col("host").isNotNull(), host_term).otherwise(F.transform("lean", lambda v: F.log(v))))
    x = x.withColumn("z", add(add(add(F.col("e"), F.coalesce("log_declared", none)), F.coalesce("log_suffix", none)), F.coalesce("prior", none)))
    x = x.withColumn("z", F.transform("z", lambda v: v - F.array_max("z"))).withColumn("q", _soft("z"))
    names = F.array(*[F.lit(v) for v in model.langs])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    flat = F.array_max("e") == F.array_min("e")
    text_lang = F.when(flat & (n > 1), F.lit(UNKNOWN)).otherwise(best(F.col("e")))
    return x.select("kind", "doc_id", "page_id", text_lang.alias("text_lang"), "declared", best(F.col("q")).alias("lang"), F.array_max("q").alias("probability"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every document with its language; the text model comes from the labelled documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return language_fusion(page_rows(pages).unionByName(document_rows(docs)), fit(docs))
