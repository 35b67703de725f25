"""Whole runs from configurations: dictionaries, or files of JSON (YAML if a parser is installed)."""

from __future__ import annotations

import glob
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe, mix, stats, taggers
from ..sources import corpus


class ConfigError(ValueError):
    """The configuration can't be run."""


def load(path: str, overrides: list[str] = ()) -> dict[str, Any]:
    """A configuration file with overrides like a.b=3 applied; values are JSON where they can be read as such.

    ``${env:NAME}`` in strings is an environment variable, ``${glob:pattern}`` a list of paths.
    """
    with open(path) as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("no YAML parser is installed; use JSON") from e
        config = yaml.safe_load(text)
    else:
        config = json.loads(text)
    for item in overrides:
        name, _, value = item.partition("=")
        at = config
        *path_, last = name.split(".")
        for p in path_:
            at = at.setdefault(p, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return _resolve(config)


def _resolve(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _resolve(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_resolve(v) for v in x]
    if isinstance(x, str) and x.startswith("${glob:") and x.endswith("}"):
        return sorted(glob.glob(x[7:-1], recursive=True))
    if isinstance(x, str) and x.startswith("${env:") and x.endswith("}"):
        return os.environ.get(x[6:-1], "")
    return x


def _need(config: dict, *names: str) -> None:
    if missing := [n for n in names if not config.get(n)]:
        raise ConfigError(f"missing: {', '.join(missing)}")


def run_tag(spark: SparkSession, config: dict) -> DataFrame:
    """documents, taggers, experiment; destination."""
    _need(config, "documents", "taggers")
    taggers.load_modules(config.get("tagger_modules", []))
    if unknown := [t for t in config["taggers"] if t not in taggers.names()]:
        raise ConfigError(f"no such tagger: {', '.join(unknown)}")
    tagged = taggers.tag(corpus.read_documents(spark, config["documents"]), config["taggers"], config.get("experiment", "exp"))
    if to := config.get("destination"):
        corpus.write_attributes(tagged, to)
    return tagged


def run_dedupe(spark: SparkSession, config: dict) -> DataFrame:
    """documents; dedupe {name, documents {key} | paragraphs {attribute_name, separator, by_ngram}, skip_empty, min_length, min_words}; seeds {documents, key,
    separator}, read_only; destination.

    A decontamination gives the evaluation set as seeds and sets read_only: documents are then compared with the seeds alone.
    """
    _need(config, "documents", "dedupe")
    how = config["dedupe"]
    if ("documents" in how) == ("paragraphs" in how):
        raise ConfigError("dedupe needs either documents or paragraphs")
    docs = corpus.read_documents(spark, config["documents"])
    common = {k: how[k] for k in ("skip_empty", "min_length", "min_words") if k in how}
    if min(common.get("min_length", 0), common.get("min_words", 0)) < 0:
        raise ConfigError("lengths are 0 at least")
    order = ["source_file", "id"]
    given = config.get("seeds", {})
    if config.get("read_only") and not given:
        raise ConfigError("read_only needs seeds")
    if given:
        _need(given, "documents")
        key = given.get("key", how.get("documents", {}).get("key", "text")).removeprefix("$.")
        seeds = corpus.read_documents(spark, given["documents"]).select(F.col(key).cast("string").alias("key"))
        if "paragraphs" in how and not how["paragraphs"].get("by_ngram"):
            seeds = seeds.select(F.explode(F.split("key", "\\Q" + how["paragraphs"].get("separator", "\n") + "\\E", -1)).alias("key"))
        common |= {"seeds": seeds, "read_only": bool(config.get("read_only"))}
    if "documents" in how:
        found = dedupe.dedupe_documents(docs, key=how["documents"].get("key", "text").removeprefix("$."), order_by=order, **common)
    elif grams := how["paragraphs"].get("by_ngram"):
        found = dedupe.dedupe_ngrams(docs, grams["ngram_length"], grams.get("stride", 0), grams.get("overlap_threshold", 1.0), grams.get("skip_short_paragraphs", False), order_by=order, separator=how["paragraphs"].get("separator", "\n"), **common)
    else:
        found = dedupe.dedupe_paragraphs(docs, order_by=order, separator=how["paragraphs"].get("separator", "\n"), **common)
    out = found.select("id", F.create_map(F.lit(how.get("name", "duplicates")), F.col("duplicates")).alias("attributes"))
    if to := config.get("destination"):
        corpus.write_attributes(out, to)
    return out


def run_mix(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """streams of name, documents, attributes, filter {include, exclude, syntax, min_text_length}, span_replacement, output {path, max_size_in_bytes, discard_fields}."""
    _need(config, "streams")
    out = {}
    for s in config["streams"]:
        _need(s, "name", "documents")
        rules, to = s.get("filter", {}), s.get("output", {})
        stream = mix.Stream(
            name=s["name"], include=rules.get("include", []), exclude=rules.get("exclude", []), syntax=rules.get("syntax", "jsonpath"), min_text_length=to.get("min_text_length", 0), discard_fields=to.get("discard_fields", []),
            span_replacement=[mix.SpanReplacement(r["span"], r.get("replacement", ""), r.get("min_score"), r.get("max_score")) for r in s.get("span_replacement", [])],
        )
        stream.validate()
        docs = corpus.read_documents(spark, s["documents"], metadata=True)
        out[s["name"]] = mix.mix(docs, stream, [corpus.read_attributes(spark, a) for a in s.get("attributes", [])])
        if to.get("path"):
            mix.write_mix(out[s["name"]].drop("source_file"), os.path.join(to["path"], s["name"]), to.get("max_size_in_bytes"))
    return out


def run_stat(spark: SparkSession, config: dict) -> DataFrame:
    """attributes, bins, name_regex, by_count; report."""
    _need(config, "attributes")
    rows = stats.histograms(corpus.read_attributes(spark, config["attributes"]), config.get("bins", 100), config.get("by_count", False), config.get("name_regex"))
    if to := config.get("report"):
        rows.write.json(to)
    return rows
