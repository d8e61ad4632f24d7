"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from galley.session import configure, shared_folder, stage

__all__ = ["SQL_CRC32", "crc_mod", "discard", "prepare", "read_table", "short_lived_shuffles", "stage", "stage_split", "text_column", "words_pattern"]

#: Python workers get Arrow batches of at most so many rows and bytes, whatever the length of a text.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20

#: A word: a run without the six ASCII white-space characters.
words_pattern = r"[^\x20\x09-\x0D]+"


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this package and its helpers, wherever they run."""
    context = spark.sparkContext
    if any(name.startswith("llm-code") for name in context._python_includes):
        return
    top = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp()) / "llm-code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for package in ("llm", "galley"):
            for file in sorted((top / package).rglob("*.py")):
                out.write(file, file.relative_to(top))
    context.addPyFile(str(archive))


def prepare(spark: SparkSession) -> None:
    """Session settings, bounded Arrow batches, and this package on the workers."""
    configure(spark)
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_split(df: DataFrame, column: str, values: list, label: str) -> list[DataFrame]:
    """Write ``df`` once and read it back as one table per value of ``column``, which they keep."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.withColumn("_part", F.col(column)).write.partitionBy("_part").parquet(path)
    whole = spark.read.schema(StructType([*df.schema, StructField("_part", df.schema[column].dataType)])).parquet(path)
    present = {row[0] for row in whole.select("_part").distinct().collect()}
    read = spark.read.schema(df.schema)
    return [read.parquet(f"{path}/_part={v}") if v in present else spark.createDataFrame([], df.schema) for v in values]


def discard(df: DataFrame) -> None:
    """Delete a staged table that is no longer needed."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside drop their shuffle files once they are written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_column(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(divisor: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % divisor


#: The same checksum in DuckDB, of a column written as text: bit by bit over its bytes (fixed polynomial).
SQL_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::UBIGINT],
  list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT))),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda k: CAST(k AS UBIGINT))),
    lambda rest, k: xor(rest >> 1, 3988292384::UBIGINT * (rest & 1)))))"""
