"""The corpus pipeline: operators of textloom.llm applied one after another to the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import materialize, release
from textloom.llm.decontaminate import decontaminate
from textloom.llm.line_dedup import line_dedup
from textloom.llm.packing import packing
from textloom.llm.quality_rules import fit, quality_filter
from textloom.llm.simhash_forest import drop_near_duplicates
from textloom.session import ship


# Every stage takes nulls in any column, empty, very long and repeated texts, empty tables and columns of any other name, and passes all columns on.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject, which are fitted on those of docs that have labels.

    Documents without a word go: null, empty and blank texts.  Without labels all others stay.
    """
    return quality_filter(docs, fit(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them, so that of copied documents one goes on; documents of nothing else go.

    n_chars is renewed where there is such a column.  A null text stays, and its n_chars is null.
    """
    out = line_dedup(docs, keep_first=True, drop_emptied=True)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; of rows alike in id and text one.  Texts without a word stay."""
    ship(spark)
    return drop_near_duplicates(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.  Null texts stay, and all do if the benchmark is empty."""
    return decontaminate(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' segments in windows and steps; documents without a token have none."""
    ship(spark)
    return packing(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", contamination),
    ("packing", pack),
]

#: The first stage scores with a trained model, the third searches by random bits, the last packs greedily: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage but the last is written as Parquet and read again.

    What the stages before it wrote is deleted once a stage's own rows are written.
    """
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
