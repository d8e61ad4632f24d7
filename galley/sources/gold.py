"""Gold annotations: reading them, and drafting templates from findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEADINGS = (
    "documents array<struct<doc_id: string, filename: string, annotations: "
    "array<struct<paragraph_index: int, is_heading: boolean, level: int, _note: string>>>>"
)
_FINDINGS = (
    "documents array<struct<filename: string, expected_violations: array<struct<type: string, "
    "paragraph_index: int, expected: boolean, _detected: boolean, _note: string>>>>"
)
NOTE_LENGTH = 60


def read_heading_gold(spark: SparkSession, path: str) -> DataFrame:
    """Labelled headings: filename, idx, is_heading, level (null unless a heading)."""
    docs = spark.read.schema(_HEADINGS).json(path, multiLine=True).select(F.explode("documents").alias("d"))
    rows = docs.select("d.filename", F.explode("d.annotations").alias("a"))
    return rows.select(
        "filename",
        F.col("a.paragraph_index").alias("idx"),
        "a.is_heading",
        F.when(F.col("a.is_heading"), F.col("a.level")).alias("level"),
    )


def read_finding_gold(spark: SparkSession, path: str) -> DataFrame:
    """Confirmed expected findings in file order: filename, seq, type, paragraph_index, note."""
    docs = spark.read.schema(_FINDINGS).json(path, multiLine=True).select(F.explode("documents").alias("d"))
    rows = docs.select("d.filename", F.posexplode("d.expected_violations").alias("seq", "e"))
    return rows.where("e.expected").select(
        "filename", "seq", "e.type", "e.paragraph_index", F.col("e._note").alias("note")
    )


def draft_annotations(findings: DataFrame) -> DataFrame:
    """Findings as gold rows to be confirmed by hand."""
    def short(name: str, label: str):
        return F.when(
            F.coalesce(name, F.lit("")) != "", F.concat(F.lit(f"{label}="), F.substring(name, 1, NOTE_LENGTH))
        )

    return findings.select(
        "doc_id",
        "type",
        F.lit(None).cast("boolean").alias("expected"),
        F.lit(True).alias("detected"),
        "paragraph_index",
        "severity",
        F.coalesce(short("section_title", "section"), short("original_text", "text")).alias("note"),
    )
