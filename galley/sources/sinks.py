"""Writing findings and exports."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.operators.dashboard import finding_counts


def report_rows(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Report counters of every processed document, zero where nothing was found."""
    return docs.select("doc_id").join(finding_counts(findings), "doc_id", "left").na.fill(0)


def replace_findings(stored: DataFrame, fresh: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored findings with all rows of the re-processed ``docs`` replaced."""
    return stored.join(docs.select("doc_id"), "doc_id", "left_anti").unionByName(fresh.select(*stored.columns))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of the latest batch of every document."""
    stored = spark.read.parquet(path)
    latest = stored.where("type IS NULL").groupBy("doc_id").agg(F.max("batch").alias("_latest"))
    rows = stored.where("type IS NOT NULL").join(latest, "doc_id")
    return rows.where("batch = _latest").drop("batch", "_latest")


def write_findings(spark: SparkSession, fresh: DataFrame, docs: DataFrame, path: str) -> None:
    """Let ``fresh`` take the place of all findings of ``docs`` in the table at ``path``.

    A batch is only added: its findings, and one marker row per document, so a
    document without findings counts too. Nothing stored is read or rewritten;
    readers take the latest batch of each document. ``compact_findings`` leaves
    old batches behind.
    """
    markers = docs.select("doc_id").distinct()
    fresh.unionByName(markers, allowMissingColumns=True).write.parquet(f"{path}/batch={time.time_ns()}")


def compact_findings(spark: SparkSession, path: str, target: str) -> None:
    """Write the current findings of the table at ``path`` as the only batch of a new table."""
    documents = spark.read.parquet(path).where("type IS NULL")
    write_findings(spark, read_findings(spark, path), documents, target)


def export_table(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a decision table or metric report as CSV (with header) or JSON lines."""
    flat = rows.select(
        *[
            F.array_join(c, ", ").alias(c) if fmt == "csv" and t.startswith("array<string") else F.col(c)
            for c, t in rows.dtypes
        ]
    )
    writer = flat.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown export format: {fmt}")
