"""Dashboards and report rows over documents, users and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.functions import text as tx
from galley.operators.labels import (
    SEVERITY_LABELS, STATUS_LABELS, TYPE_CATEGORIES, TYPE_LABELS, UNKNOWN_CATEGORY, UNKNOWN_LABEL, mapping_table,
)
from galley.scan import running_sum, scan

RECENT = 10
CALENDAR_DAYS = 30


def scope(docs: DataFrame, users: DataFrame, supervisor_id: int | None) -> DataFrame:
    """Documents of a supervisor's students, or all."""
    if supervisor_id is None:
        return docs
    mine = users.where(F.col("supervisor_id") == supervisor_id).select("user_id")
    return docs.join(mine, "user_id", "left_semi")


def totals(docs: DataFrame, users: DataFrame, supervisor_id: int | None = None) -> DataFrame:
    """One row: documents and students in scope, all users."""
    student = F.col("role") == "student"
    if supervisor_id is not None:
        student = student & (F.col("supervisor_id") == supervisor_id)
    rows = (
        scope(docs, users, supervisor_id)
        .select(F.lit(1).alias("document"), F.lit(0).alias("person"), F.lit(0).alias("student"))
        .unionByName(
            users.select(
                F.lit(0).alias("document"), F.lit(1).alias("person"), tx.is_true(student).cast("int").alias("student")
            )
        )
    )
    return rows.agg(
        F.coalesce(F.sum("document"), F.lit(0)).alias("total_documents"),
        F.coalesce(F.sum("person"), F.lit(0)).alias("total_users"),
        F.coalesce(F.sum("student"), F.lit(0)).alias("total_students"),
    )


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings per document by status and severity."""
    def count(column, value, name):
        return F.count_if(F.col(column) == value).alias(name)

    return findings.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        count("status", "auto_fixed", "fixed"),
        count("status", "manual_required", "manual"),
        count("severity", "critical", "critical"),
        count("severity", "warning", "warning"),
        count("severity", "info", "info"),
    )


def report_averages(docs: DataFrame, reports: DataFrame) -> DataFrame:
    """One row: average findings and all automatic fixes of the documents in scope."""
    return reports.join(docs.select("doc_id"), "doc_id", "left_semi").agg(
        F.coalesce(F.avg("total"), F.lit(0.0)).alias("avg_violations"),
        F.coalesce(F.sum("fixed"), F.lit(0)).alias("total_auto_fixed"),
    )


def uploads_by_day(docs: DataFrame, today: Column, days: int = CALENDAR_DAYS) -> DataFrame:
    """Uploads of each of the last ``days`` days, zero where there were none."""
    spark = docs.sparkSession
    first = F.date_sub(today, days - 1)
    calendar = spark.range(1).select(F.explode(F.sequence(first, today)).alias("day"))
    counted = (
        docs.where(F.to_date("uploaded_at") >= first)
        .groupBy(F.to_date("uploaded_at").alias("day"))
        .agg(F.count("*").alias("n"))
    )
    return calendar.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("uploads"))


def violations_by_category(findings: DataFrame) -> DataFrame:
    """Findings per category with their rounded share.

    Types are counted first, so only a few dozen rows meet the category table.
    """
    table = mapping_table(findings.sparkSession, TYPE_CATEGORIES, "type", "category")
    by_type = findings.groupBy("type").agg(F.count("*").alias("n"))
    by_category = (
        by_type.join(F.broadcast(table), "type", "left")
        .groupBy(F.coalesce("category", F.lit(UNKNOWN_CATEGORY)).alias("category"))
        .agg(F.sum("n").alias("count"))
    )
    # At most one row per category is left here.
    total = F.greatest(F.sum("count").over(Window.partitionBy(F.lit(1))), F.lit(1))
    share = F.bround(F.col("count") * 100 / total).cast("long")
    return by_category.select("category", "count", share.alias("percent"))


def recent_uploads(docs: DataFrame, users: DataFrame, reports: DataFrame, limit: int = RECENT) -> DataFrame:
    """The newest documents with owner and number of findings (null: not processed).

    The top-k is taken before the joins.
    """
    newest = docs.orderBy(F.col("uploaded_at").desc(), F.col("doc_id")).limit(limit)
    owners = users.select("user_id", F.col("full_name").alias("owner_full_name"))
    return (
        newest.join(owners, "user_id")
        .join(reports.select("doc_id", F.col("total").alias("violations")), "doc_id", "left")
        .select("doc_id", "original_filename", "owner_full_name", "uploaded_at", "violations", "status")
    )


def student_card_counts(findings: DataFrame) -> DataFrame:
    """Counts on a student's page: open critical, open warnings, automatic fixes."""
    manual = F.col("status") == "manual_required"
    return findings.groupBy("doc_id").agg(
        F.count_if(manual & (F.col("severity") == "critical")).alias("critical_open"),
        F.count_if(manual & (F.col("severity") == "warning")).alias("warning_open"),
        F.count_if(F.col("status") == "auto_fixed").alias("auto_fixed"),
    )


def with_type_labels(findings: DataFrame) -> DataFrame:
    """Add ``label``, the name shown for the type."""
    table = mapping_table(findings.sparkSession, TYPE_LABELS, "type", "label")
    return findings.join(F.broadcast(table), "type", "left").withColumn(
        "label", F.coalesce("label", F.lit(UNKNOWN_LABEL))
    )


def finding_report_rows(findings: DataFrame, order: list[str]) -> DataFrame:
    """Report rows numbered per document in the given order, with names for codes."""
    spark = findings.sparkSession
    severities = mapping_table(spark, SEVERITY_LABELS, "severity", "severity_label")
    statuses = mapping_table(spark, STATUS_LABELS, "status", "status_label")
    named = (
        with_type_labels(findings)
        .join(F.broadcast(severities), "severity", "left")
        .join(F.broadcast(statuses), "status", "left")
        .withColumn("severity_label", F.coalesce("severity_label", "severity"))
        .withColumn("status_label", F.coalesce("status_label", "status"))
    )
    return scan(named, ["doc_id"], order, ranged=True, row_number=running_sum(F.lit(1).cast("long")))
