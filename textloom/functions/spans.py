"""Rewriting text by spans, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPANS


def chosen_spans(spans: Column, text: Column, min_score: float | None = None, max_score: float | None = None) -> Column:
    """The spans that rewriting uses: of min_score <= score < max_score, not empty, inside the text, by start; of those that overlap the first."""
    ok = F.filter(spans, lambda s: (s["end"] > s["start"]) & (s["start"] < F.length(text)))
    if min_score is not None:
        ok = F.filter(ok, lambda s: s["score"] >= min_score)
    if max_score is not None:
        ok = F.filter(ok, lambda s: s["score"] < max_score)
    # stable by start: the place in the list breaks ties
    indexed = F.transform(ok, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["score"].alias("score")))
    placed = F.array_sort(indexed)
    kept = F.aggregate(
        placed,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), s["score"].cast("double").alias("score")))).alias("out")),
        ).otherwise(acc),
    )
    return F.coalesce(kept["out"], F.array().cast(SPANS))


def replace_spans(text: Column, spans: Column, replacement: str | Column, min_score: float | None = None, max_score: float | None = None) -> Column:
    """The text with each chosen span replaced; {} in the replacement stands for the span's text."""
    new = F.lit(replacement) if isinstance(replacement, str) else replacement
    done = F.aggregate(
        chosen_spans(spans, text, min_score, max_score),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            s["end"].alias("at"),
            F.concat(acc["out"], _part(text, acc["at"], s["start"]), F.replace(new, F.lit("{}"), _part(text, s["start"], s["end"]))).alias("out"),
        ),
    )
    return F.concat(done["out"], _part(text, done["at"], F.length(text)))


def _part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
