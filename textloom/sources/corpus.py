"""Documents and attributes as JSON lines, in the folder layout documents/ beside attributes/{name}/, and other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPANS

DOCUMENT = "id string, text string, source string, created string, added string, version string"


def read_documents(spark: SparkSession, path: str | list[str], metadata: bool = False, fail_fast: bool = True) -> DataFrame:
    """Documents of JSON lines (gz, zst, bz2 or plain) with the file each comes from; metadata, if asked for, as VARIANT.

    A line that can't be read fails the query, or is left out without ``fail_fast``.  Fields that aren't asked for are never parsed.
    """
    schema = DOCUMENT + (", metadata variant" if metadata else "")
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if fail_fast else "DROPMALFORMED").option("recursiveFileLookup", "true")
    return reader.json(path).withColumn("source_file", F.col("_metadata.file_path"))


def read_attributes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, attributes) of JSON lines in which spans are arrays [start, end, score]."""
    raw = spark.read.schema("id string, attributes map<string,array<array<double>>>").option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)
    spans = F.transform_values("attributes", lambda _, its: F.transform(its, lambda s: F.struct(s[0].cast("long").alias("start"), s[1].cast("long").alias("end"), s[2].alias("score"))))
    return raw.select("id", spans.cast(f"map<string,{SPANS}>").alias("attributes"))


def write_attributes(tagged: DataFrame, path: str, compression: str = "gzip") -> None:
    """Attributes as JSON lines with spans as arrays."""
    spans = F.transform_values("attributes", lambda _, its: F.transform(its, lambda s: F.array(s["start"].cast("double"), s["end"].cast("double"), s["score"])))
    tagged.select("id", spans.alias("attributes")).write.option("compression", compression).json(path)


def write_documents(docs: DataFrame, path: str, compression: str = "gzip", by_file: bool = False) -> None:
    """Documents as JSON lines; ``by_file`` keeps those of a source file together."""
    writer = docs.write.option("compression", compression)
    (writer.partitionBy("source_file") if by_file else writer).json(path)


def columns_to_documents(table: DataFrame, text_col: str = "content", id_col: str | None = "id", source: str = "") -> DataFrame:
    """Documents of any table: its other columns go to metadata as strings; without an id the text's MD5 is one."""
    own = F.md5(F.col(text_col))
    has = bool(id_col and id_col in table.columns)
    doc_id = F.coalesce(F.col(id_col).cast("string"), own) if has else own
    rest = [c for c in table.columns if c not in (text_col, *([id_col] if has else []))]
    metadata = F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(c).cast("string") for c in rest])) if rest else F.create_map().cast("map<string,string>")
    return table.select(doc_id.alias("id"), F.col(text_col).alias("text"), F.lit(source).alias("source"), metadata.alias("metadata"))


def hashed_documents(table: DataFrame, text_col: str, source: str) -> DataFrame:
    """Documents whose id is their text's MD5, made now."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table.select(F.md5(F.col(text_col)).alias("id"), F.col(text_col).alias("text"), F.lit(source).alias("source"), now.alias("created"), now.alias("added"))


def wiki_documents(extracted: DataFrame, lang: str = "en") -> DataFrame:
    """Documents of extracted wiki pages (id, title, text, url): title and text, without pages of no text."""
    rows = extracted.where(F.trim("text") != "")
    return rows.select(F.col("id").cast("string").alias("id"), F.concat_ws("\n\n", "title", F.trim("text")).alias("text"), F.lit(f"wiki-{lang}").alias("source"), F.struct("title", "url").alias("metadata"))


