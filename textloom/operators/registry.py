"""Named taggers and the operator that applies them."""

from __future__ import annotations

import importlib
import importlib.util
import sys
from collections.abc import Callable, Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ATTRIBUTES, SPANS

#: What a Python tagger returns for a document: spans (start, end, score) by type.
Spans = dict[str, list[tuple[int, int, float]]]

NATIVE: dict[str, Callable[[Column, Column], dict[str, Column]]] = {}
PYTHON: dict[str, Callable[[], Callable[[str, dict], Spans]]] = {}
DEFAULTS: dict[str, tuple[str, ...]] = {}
#: Taggers that read fields of the documents beside text.
FIELDS: dict[str, tuple[str, ...]] = {}

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_ARROW = pa.map_(pa.string(), pa.list_(_SPAN))


def _claim(name: str, made: Callable) -> None:
    old = NATIVE.get(name) or PYTHON.get(name)
    if old and getattr(old, "__module__", "") != "__main__" and old is not made:
        raise ValueError(f"a tagger named {name} exists already")


def native(name: str):
    """Registers a function (text, id) -> {type: array of spans} of native expressions."""

    def keep(make):
        _claim(name, make)
        NATIVE[name] = make
        return make

    return keep


def add_tagger(name: str, defaults: Iterable[str] = (), fields: Iterable[str] = ()):
    """Registers a function without arguments that returns predict(text, fields) -> spans by type, called once in each worker.

    ``defaults`` are types that every document has, with no span if none is found; ``fields`` are columns that it reads.
    """

    def keep(make):
        _claim(name, make)
        PYTHON[name], DEFAULTS[name], FIELDS[name] = make, tuple(defaults), tuple(fields)
        return make

    return keep


def names() -> list[str]:
    return sorted({*NATIVE, *PYTHON})


def tagger_rows() -> list[tuple[str, str, str]]:
    """(name, kind, doc) of every registered tagger."""
    return [(n, "native" if n in NATIVE else "python", ((NATIVE.get(n) or PYTHON[n]).__doc__ or "").strip().split("\n")[0]) for n in names()]


def tagger_table(spark: SparkSession) -> DataFrame:
    """tagger_rows() as a table."""
    return spark.createDataFrame(tagger_rows(), "name string, kind string, doc string")


def load_modules(modules: Iterable[str]) -> None:
    """Imports modules that register taggers, by name or by path."""
    for m in modules:
        if m.endswith(".py") or "/" in m:
            path = Path(m)
            spec = importlib.util.spec_from_file_location(path.stem, path if path.suffix else path / "__init__.py")
            module = importlib.util.module_from_spec(spec)
            sys.modules[path.stem] = module
            spec.loader.exec_module(module)
        else:
            importlib.import_module(m)


def _python_udf(wanted: list[str]):
    makers = {n: PYTHON[n] for n in wanted}
    defaults = {n: DEFAULTS[n] for n in wanted}
    cache: dict = {}

    def run(texts: pa.Array, fields: pa.Array) -> pa.Array:
        if not cache:
            cache.update({n: make() for n, make in makers.items()})
        out = []
        for text, more in zip(texts.to_pylist(), fields.to_pylist()):
            found: list = []
            for n, predict in cache.items():
                spans = {k: [] for k in defaults[n]}
                for kind, its in predict(text or "", more or {}).items():
                    spans[kind] = [(int(a), int(b), round(float(s), 5)) for a, b, s in its]
                found += [(f"{n}__{kind}", [{"start": a, "end": b, "score": s} for a, b, s in its]) for kind, its in spans.items()]
            out.append(found)
        return pa.array(out, _ARROW)

    run.__annotations__ = {"texts": pa.Array, "fields": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ATTRIBUTES).asNondeterministic()  # so that it runs once a row


def attributes(text: Column, doc_id: Column, taggers: Iterable[str], experiment: str, fields: dict[str, Column] | None = None) -> Column:
    """map of {experiment}__{tagger}__{type} to spans.  Native taggers fuse into one projection, the others into one pass over Arrow batches."""
    taggers = list(taggers)
    if unknown := [n for n in taggers if n not in NATIVE and n not in PYTHON]:
        raise ValueError(f"no such tagger: {', '.join(unknown)}")
    parts = []
    for n in taggers:
        if n in NATIVE:
            its = NATIVE[n](text, doc_id)
            parts.append(F.map_from_arrays(F.array(*[F.lit(f"{experiment}__{n}__{k}") for k in its]), F.array(*[v.cast(SPANS) for v in its.values()])))
    if python := [n for n in taggers if n in PYTHON]:
        wanted = sorted({f for n in python for f in FIELDS[n]})
        given = {k: v for k, v in (fields or {}).items() if k in wanted}
        packed = F.struct(*[v.cast("string").alias(k) for k, v in given.items()]) if given else F.struct(F.lit(None).cast("string").alias("none"))
        parts.append(F.transform_keys(_python_udf(python)(text, packed), lambda k, v: F.concat(F.lit(f"{experiment}__"), k)))
    return F.map_concat(*parts) if len(parts) > 1 else parts[0]


def tag(docs: DataFrame, taggers: Iterable[str], experiment: str = "exp", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, attributes) of every document; a null text is tagged as an empty one."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("id"), attributes(text, docs[id_col], taggers, experiment, {c: docs[c] for c in docs.columns}).alias("attributes"))


def with_attributes(docs: DataFrame, taggers: Iterable[str], experiment: str = "exp", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """docs with their attributes as a column, for a mix in the same plan: nothing is joined then."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.withColumn("attributes", attributes(text, docs[id_col], taggers, experiment, {c: docs[c] for c in docs.columns}))


def spans(tagged: DataFrame) -> DataFrame:
    """(id, experiment, tagger, type, start, end, score): one row for each span."""
    rows = tagged.select("id", F.explode("attributes").alias("key", "its")).select("id", F.split("key", "__", 3).alias("k"), F.explode("its").alias("s"))
    return rows.select("id", *(F.col("k")[i].alias(n) for i, n in enumerate(("experiment", "tagger", "type"))), "s.start", "s.end", "s.score")
