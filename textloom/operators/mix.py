"""Mixing: documents joined with attributes, filtered, rewritten, projected and written again."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import replace_spans
from ..functions.text import ATTRIBUTES, SPANS, strip
from ..plans import jq, jsonpath


@dataclass
class SpanReplacement:
    """Which attribute's spans are replaced, by what, and for which scores (least <= score < most)."""

    span: str
    replacement: str = ""
    min_score: float | None = None
    max_score: float | None = None


@dataclass
class Stream:
    """One stream of a mix.  ``syntax`` is "jsonpath" or "jq"."""

    name: str = "stream"
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    syntax: str = "jsonpath"
    span_replacement: list[SpanReplacement] = field(default_factory=list)
    discard_fields: list[str] = field(default_factory=list)
    min_text_length: int = 0

    def validate(self) -> None:
        """Raises ValueError for settings that can't work, before any data is read."""
        if self.syntax not in ("jsonpath", "jq"):
            raise ValueError(f"no such syntax: {self.syntax}")
        if not (self.include or self.exclude or self.span_replacement or self.discard_fields or self.min_text_length):
            raise ValueError(f"stream {self.name} has neither filter nor replacement")
        for r in self.span_replacement:
            if r.min_score is None and r.max_score is None:
                raise ValueError(f"the replacement of {r.span} needs a least or a greatest score")
        for p in [*self.include, *self.exclude]:
            if self.syntax == "jq":
                jq.Parser(p).parse()
            elif not p.startswith("$"):
                raise ValueError(f"a path begins with $: {p}")


def merge_attributes(docs: DataFrame, sets: Iterable[DataFrame], id_col: str = "id", check: bool = True) -> DataFrame:
    """docs with a column ``attributes``: theirs, if any, overwritten key by key by each set (id, attributes) in turn.

    A document that a set lacks keeps what it has.  With ``check`` a set that holds an id twice, or ids that no document has, fails
    the query: its rows don't belong to these documents.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{SPANS}>")).cast(ATTRIBUTES)
    out = docs if "attributes" in docs.columns else docs.withColumn("attributes", none)
    ids = docs.select(docs[id_col].alias("_id"))
    for k, s in enumerate(sets):
        key, more = F.col(f"_id{k}"), F.col(f"_more{k}")
        right = s.select(F.col("id").alias(f"_id{k}"), F.col("attributes").alias(f"_more{k}"))
        if check:
            right = right.groupBy(key).agg(F.first(more).alias(f"_more{k}"), F.count("*").alias("_times"))
            right = right.withColumn(f"_more{k}", F.when(F.col("_times") == 1, more).otherwise(F.raise_error(F.concat(F.lit("attributes repeat the id "), key.cast("string"))).cast(ATTRIBUTES))).drop("_times")
        joined = out.join(right, out[id_col] == key, "left")
        kept = F.map_filter("attributes", lambda key, _: ~F.map_contains_key(F.coalesce(more, none), key))
        out = joined.withColumn("attributes", F.when(more.isNull(), F.col("attributes")).otherwise(F.map_concat(kept, more))).drop(f"_id{k}", f"_more{k}")
        if check:
            # ids alone meet here: a row that no document has fails the query, so this adds none
            found = s.select(F.col("id").alias("_id")).join(ids.withColumn("_there", F.lit(True)), "_id", "left")
            fail = F.raise_error(F.concat(F.lit("attributes of no document: "), F.coalesce(F.col("_id").cast("string"), F.lit("null"))))
            strange = found.where(F.when(F.col("_there").isNull(), fail.cast("boolean")).otherwise(F.lit(False)))
            out = out.unionByName(strange.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema]))
    return out


def named_fields(columns: list[str], programs: list[str]) -> tuple[list[str], list[str] | None]:
    """The columns that programs can read, and the attributes, None for all of them.

    A program that reads the document or its attributes as a whole needs all; others no more than the names that occur in them.
    """
    text = "\n".join(programs)
    quoted = {x for its in re.findall(r"'([^']*)'|\"([^\"]*)\"", text) for x in its}
    words = {*re.findall(r"[A-Za-z_][\w-]*", text), *re.findall(r"[A-Za-z_]\w*", text), *quoted}
    # $ or a dot that no name follows is the document; after a name a dot or bracket reads a part of it
    whole = re.search(r"\$(?!\s*(?:\.[A-Za-z_]|\[\s*['\"]))|(?<![\w\])\"'.@])\.(?![A-Za-z_\"]|\s*\[\s*\")", text)
    if whole or "\\" in text:
        return columns, None
    parts = re.search(r"attributes['\"]?\]?(?!['\"\]\w])\s*(?!\.[A-Za-z_\"]|\.?\[\s*['\"]|\[\?\()", text)
    return [c for c in columns if c in words], None if parts else sorted(words)


def as_variant(docs: DataFrame, programs: list[str] | None = None) -> Column:
    """The row as JSON, spans as arrays [start, end, score]; columns of type VARIANT keep their structure.  With ``programs`` it has the fields
    that they can read alone, so that texts aren't rendered and parsed to look at something else."""
    columns, wanted = named_fields(docs.columns, programs) if programs is not None else (docs.columns, None)
    fields = [F.lit(1).alias("")] if not columns else []
    for c, t in docs.dtypes:
        if c not in columns:
            continue
        if c == "attributes" and t.startswith("map"):
            its = F.col(c) if wanted is None else F.map_filter(c, lambda k, _: k.isin(wanted))
            spans = F.transform_values(its, lambda _, its: F.transform(its, lambda s: F.array(s["start"].cast("double"), s["end"].cast("double"), s["score"])))
            fields.append(spans.alias(c))
        else:
            fields.append(F.col(c))
    return F.parse_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def keep(doc: Column, stream: Stream) -> Column:
    """Some include (or none is given) and no exclude finds something."""
    test = (lambda p: jq.truthy(doc, p)) if stream.syntax == "jq" else (lambda p: jsonpath.matches(doc, p))
    some = F.lit(not stream.include)
    for p in stream.include:
        some = some | test(p)
    for p in stream.exclude:
        some = some & ~test(p)
    return some


def mix(docs: DataFrame, stream: Stream, attributes: Iterable[DataFrame] = (), id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The stream's documents.  Filters come first, then replacements in order, then the least length in bytes, then discarded fields."""
    stream.validate()
    out = merge_attributes(docs, attributes, id_col)
    if stream.include or stream.exclude:
        # a projection that isn't deterministic keeps its place below the filter, so that a document is parsed once for all conditions
        doc, kept = "_document", "_kept"
        out = out.withColumn(doc, as_variant(out, [*stream.include, *stream.exclude])).withColumn(kept, keep(F.col(doc), stream) & (F.rand(0) >= 0))
        out = out.where(kept).drop(doc, kept)
    for r in stream.span_replacement:
        name = r.span.removeprefix("$.attributes.").removeprefix(".attributes.").strip("[]'\"")
        new: str | Column = r.replacement
        if new.startswith("$."):
            new = F.coalesce(jsonpath.select(as_variant(out, [new]), new, "string"), F.lit(""))
        elif new.startswith("$"):
            new = jq.text(as_variant(out, [new[1:]]), new[1:].strip())
        its = F.coalesce(F.try_element_at("attributes", F.lit(name)), F.array().cast(SPANS))
        out = out.withColumn(text_col, replace_spans(F.col(text_col), its, new, r.min_score, r.max_score))
    if stream.min_text_length:
        out = out.where(F.octet_length(strip(F.col(text_col))) >= stream.min_text_length)
    return out.drop(*stream.discard_fields)


def provenance(docs: DataFrame, line_col: str = "line", file_col: str = "file") -> DataFrame:
    """docs with provenance = file:line, lines from 1, instead of these columns."""
    return docs.withColumn("provenance", F.concat_ws(":", F.element_at(F.split(F.col(file_col), "/"), -1), (F.col(line_col) + 1).cast("string"))).drop(line_col, file_col)


def write_mix(docs: DataFrame, path: str, max_bytes: int | None = None, compression: str = "gzip", row_bytes: int = 2000) -> None:
    """The documents as JSON lines, in files of about ``max_bytes`` of text; Spark's commit protocol makes the output atomic."""
    writer = docs.write.mode("errorifexists").option("compression", compression)
    if max_bytes:
        writer = writer.option("maxRecordsPerFile", max(1, max_bytes // row_bytes))
    writer.json(path)
