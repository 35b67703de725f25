"""What the operators of this subpackage share: column handling, tables in the shared folder, corpus keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id wherever ids are compared or ordered: rows without an id sort last.  It doesn't say which document a row is.
NO_ID = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's spark.checkpoint.dir names it.

    Only a local session may lack the setting; it then gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends there and a lost executor costs nothing.

    ``by`` names a column that the table is partitioned by.  The application's folder goes when its JVM ends; release() deletes it earlier.
    """
    spark = df.sparkSession
    path = f"{_own(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


_DOOMED: set[str] = set()


def _own(spark: SparkSession) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/textloom-{spark.sparkContext.applicationId}"
    if path not in _DOOMED:
        _file_system(spark, path)[0].deleteOnExit(_file_system(spark, path)[1])
        _DOOMED.add(path)
    return path


def _file_system(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def release(spark: SparkSession, keep: DataFrame | None = None) -> None:
    """Deletes the tables that this application wrote by materialize(), but for ``keep``, one of them; call it when the others' readers are done."""
    files, path = _file_system(spark, _own(spark))
    kept = getattr(keep, "written_to", "").rsplit("/", 1)[-1]
    if not kept:
        files.delete(path, True)
    elif files.exists(path):
        for status in files.listStatus(path):
            if status.getPath().getName() != kept:
                files.delete(status.getPath(), True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(df: DataFrame, name: str) -> Column:
    """The column of that very name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def has_words(text: Column) -> Column:
    """Whether a text holds anything but white space; false for null."""
    return F.coalesce(text.rlike(r"\S"), F.lit(False))


def doc_key(df: DataFrame, id_col: str) -> Column:
    return F.coalesce(col(df, id_col).cast("long"), F.lit(NO_ID))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
