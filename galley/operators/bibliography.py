"""The list of sources: entries, numbering, and agreement with the citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions import text as tx
from galley.operators.features import DOC
from galley.session import stage
from galley.scan import following, last, prev, running_max, running_sum, scan
from galley.schema import findings

# Shapes of entries, continuations, broken numbers and group headers.
_ENTRY = r"(?Us)^(\d+)[.)]\s+(.*)$"
_GLUE = r"(?U)(?<=[.;)\]])\s+(?=\d{1,3}[).]\s+)"
_DASH_START = r"^[–—\-]"
_CONTINUES = r"(?iU)^(?:№|n\b|no\.?|с\.|стр\.|pp?\.|url\b|doi\b|\[электронный ресурс\])"
_BROKEN_NUMBER = r"(?U)^\s*\d+\s*(?:[-–—]\s*\d+|[.,]\d)"
_YEAR = r"(?U)\b(19|20)\d{2}\b"
_URL = r"(?iU)https?://|www\."
_STANDARD = r"(?iU)\bГОСТ\b|\bISO\b|\bRFC\b|\bСНиП\b|\bСП\s+\d|\bФЗ\b|\bПриказ\b|\bОСТ\b"
_STARTS_ENTRY = r"^[«\"“„(]?[A-ZА-ЯЁ]"
_GROUP_HEADER = r"(?U)^[IVXLCDMivxlcdm]+[.)]\s+\S"
SHORT_ENTRY = 20
RUN_NUMBERS = 1000


def in_references(features: DataFrame, bounds: DataFrame) -> DataFrame:
    """Non-empty paragraphs of the source list."""
    limits = bounds.select(F.col("doc_id").alias("_d"), "start", "end").hint("shuffle_hash")
    return (
        features.where(~F.col("is_empty"))
        .join(limits, F.col("doc_id") == F.col("_d"))
        .where("idx >= start AND (end IS NULL OR idx < end)")
        .select("doc_id", "idx", "stripped", "numpr_num_id")
    )


def _body(entry):
    return tx.strip_blank(F.regexp_extract(entry, _ENTRY, 2))


def entry_candidates(listed: DataFrame) -> DataFrame:
    """Add how each paragraph of the source list is read, and its raw entries."""
    lines = F.transform(F.split("stripped", "\n"), tx.strip_blank)
    parts = F.filter(
        F.transform(F.flatten(F.transform(lines, lambda line: F.split(line, _GLUE))), tx.strip_blank),
        lambda p: p != "",
    )
    glued = (F.size("_parts") > 1) & F.forall(
        "_parts",
        lambda p: p.rlike(_ENTRY) & ~_body(p).rlike(_DASH_START) & ~_body(p).rlike(_CONTINUES),
    )
    single = F.col("stripped").rlike(_ENTRY)
    kind = (
        F.when(glued, "glued")
        .when(single & ~_body(F.col("stripped")).rlike(_CONTINUES), "single")
        .when(single, "other")
        .when(F.col("numpr_num_id").isNotNull(), "auto")
        .when(F.col("stripped").rlike(_BROKEN_NUMBER), "malformed")
        .otherwise("other")
    )
    return (
        listed.withColumn("_parts", parts)
        .withColumn("kind", kind)
        .withColumn(
            "entries",
            F.when(F.col("kind") == "glued", F.col("_parts"))
            .when(F.col("kind").isin("single", "auto"), F.array("stripped"))
            .otherwise(F.array().cast("array<string>")),
        )
        .drop("_parts")
    )


def bib_entries(listed: DataFrame) -> DataFrame:
    """Entries of the source list: doc_id, idx, part_no, number, body."""
    rows = entry_candidates(listed).where(F.size("entries") > 0)
    rows = scan(rows, DOC, ["idx"], _so_far=running_sum(F.size("entries").cast("long"), inclusive=False))
    entry = F.col("entry")
    typed = F.col("kind") != "auto"
    return rows.select(
        "doc_id", "idx", "kind", "_so_far", F.posexplode("entries").alias("part_no", "entry")
    ).select(
        "doc_id",
        "idx",
        "part_no",
        F.when(typed, F.regexp_extract(entry, _ENTRY, 1).try_cast("long"))
        .otherwise(F.col("_so_far") + 1)
        .alias("number"),
        F.when(typed, _body(entry)).otherwise(entry).alias("body"),
    )


def bib_malformed(listed: DataFrame) -> DataFrame:
    """Entries numbered with a range or a fraction."""
    return findings(
        entry_candidates(listed).where("kind = 'malformed'"),
        "bibliography_entry_malformed",
        "п. 6.16",
        description=F.lit(
            "Запись списка источников имеет некорректный номер (например, диапазон «18-32»). "
            "Каждый источник нумеруется отдельным арабским числом."
        ),
        paragraph_index=F.col("idx"),
        original_text=F.col("stripped"),
    )


def bib_missing(docs: DataFrame, bounds: DataFrame, entries: DataFrame) -> DataFrame:
    """No source list, or a list in which nothing could be read."""
    absent = docs.select("doc_id").join(bounds, "doc_id", "left_anti")
    empty = bounds.select("doc_id").join(entries, "doc_id", "left_anti")
    return findings(
        absent,
        "bibliography_missing",
        "п. 6.16",
        severity="critical",
        description=F.lit("Раздел «Список использованных источников» не найден."),
    ).unionByName(
        findings(
            empty,
            "bibliography_entries_unrecognised",
            "п. 6.16",
            description=F.lit(
                "Записи источников не распознаны — возможно, нестандартный формат "
                "оформления. Требуется ручная проверка."
            ),
        )
    )


def bib_numbering_gap(entries: DataFrame) -> DataFrame:
    """Entry numbers that do not follow the one before."""
    rows = scan(entries, DOC, ["idx", "part_no"], _before=prev(F.col("number")))
    expected = F.coalesce("_before", F.lit(0)) + 1
    return findings(
        rows.where(F.col("number") != expected),
        "bibliography_numbering_gap",
        "п. 6.16",
        description=F.concat(
            F.lit("Нарушена нумерация в списке источников: ожидался "), expected.cast("string"),
            F.lit(", найден "), F.col("number").cast("string"), F.lit("."),
        ),
        paragraph_index=F.col("idx"),
        original_text=F.col("body"),
    )


def missing_runs(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """Runs of cited numbers that are not listed: doc_id, lo, hi, idx, raw_token.

    Only manuscripts with a list count. Walking up the numbers, a run starts at
    a piece of first mentions or behind a listed number, and ends before the next
    listed one.
    """
    number = F.col("number").cast("long")
    points = entries.select("doc_id", number.alias("n"), F.lit(1).alias("_listed"), number.alias("_point")).distinct()
    pieces = mentions.join(entries.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", F.col("lo").alias("n"), F.lit(0).alias("_listed"), F.struct("hi", "idx", "raw_token").alias("_piece")
    )
    walked = scan(
        pieces.unionByName(points, allowMissingColumns=True),
        DOC,
        ["n", "_listed"],
        ranged=True,
        _over=last(F.col("_piece")),
        _next=following(F.col("_point")),
    )
    inside = walked.where(F.col("n") <= F.col("_over.hi") - F.col("_listed"))
    return inside.select(
        "doc_id",
        (F.col("n") + F.col("_listed")).alias("lo"),
        F.least(F.col("_over.hi"), F.col("_next") - 1).alias("hi"),
        "_over.idx",
        "_over.raw_token",
    ).where("lo <= hi")


def citation_without_source(mentions: DataFrame, entries: DataFrame) -> DataFrame:
    """Cited numbers that are not listed, anchored at their first mention.

    One finding a number; a run of more than ``RUN_NUMBERS`` numbers of one range
    is one finding that names both ends, however wide the range.
    """
    long_run = F.col("hi") - F.col("lo") >= RUN_NUMBERS
    numbers = F.when(long_run, F.array("lo")).otherwise(F.sequence("lo", "hi"))
    rows = missing_runs(mentions, entries).select("*", long_run.alias("_long"), F.explode(numbers).alias("n"))
    one = F.concat(
        F.lit("Ссылка ["), F.col("n").cast("string"),
        F.lit("] встречается в тексте, но отсутствует в списке источников."),
    )
    many = F.concat(
        F.lit("Ссылки ["), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"),
        F.lit("] встречаются в тексте, но отсутствуют в списке источников."),
    )
    return findings(
        rows,
        "citation_without_source",
        "п. 6.16",
        severity="critical",
        description=F.when(F.col("_long"), many).otherwise(one),
        paragraph_index=F.col("idx"),
        original_text=F.col("raw_token"),
    )


def source_not_cited(ranges: DataFrame, entries: DataFrame) -> DataFrame:
    """Listed numbers that no cited range ``ranges(doc_id, lo, hi)`` covers.

    Walking up the numbers of a manuscript, a listed one is cited if some range
    that began at or before it reaches it; no range is expanded.
    """
    known = entries.select("doc_id", F.col("number").cast("long").alias("n"), F.lit(1).alias("_listed")).distinct()
    begun = ranges.groupBy("doc_id", F.col("lo").alias("n")).agg(F.max("hi").alias("_reach")).withColumn("_listed", F.lit(0))
    both = known.unionByName(begun, allowMissingColumns=True)
    walked = scan(both, DOC, ["n", "_listed"], ranged=True, _covered=running_max(F.col("_reach")))
    return findings(
        walked.where("_listed = 1 AND (_covered IS NULL OR _covered < n)"),
        "source_not_cited",
        "п. 6.16",
        description=F.concat(
            F.lit("Источник "), F.col("n").cast("string"),
            F.lit(" присутствует в списке, но не цитируется в тексте."),
        ),
    )


def bib_incomplete(entries: DataFrame) -> DataFrame:
    """Entries that are too short or carry no year, unless online or a standard."""
    body = F.col("body")
    exempt = body.rlike(_URL) | body.rlike(_STANDARD)
    poor = (F.length("body") < SHORT_ENTRY) | ~body.rlike(_YEAR)
    return findings(
        entries.where(~exempt & poor),
        "bibliography_entry_incomplete",
        "п. 6.16",
        description=F.concat(
            F.lit("Запись "), F.col("number").cast("string"),
            F.lit(" в списке источников короче ожидаемой или не содержит года издания."),
        ),
        paragraph_index=F.col("idx"),
        original_text=body,
    )


def autonumber(listed: DataFrame) -> DataFrame:
    """Numbers for entries typed without one: doc_id, idx, number, new_text.

    A typed number re-seeds the counter; a list item or an unnumbered entry
    start moves it on by one.
    """
    text = F.col("stripped")
    explicit = F.when(text.rlike(_ENTRY), F.regexp_extract(text, _ENTRY, 1).try_cast("long"))
    needs = (
        ~text.rlike(_ENTRY)
        & F.col("numpr_num_id").isNull()
        & text.rlike(_STARTS_ENTRY)
        & ~text.rlike(_GROUP_HEADER)
    )
    moves = ~text.rlike(_ENTRY) & (F.col("numpr_num_id").isNotNull() | needs)
    rows = listed.select(
        "doc_id", "idx", "stripped", explicit.alias("explicit"), needs.alias("needs"), moves.alias("moves")
    )
    rows = stage(scan(rows, DOC, ["idx"], _moved=running_sum(F.col("moves").cast("long"))), "moved-entries")
    rows = scan(
        rows, DOC, ["idx"], _seed=last(F.when(F.col("explicit").isNotNull(), F.struct("explicit", "_moved")))
    )
    number = F.coalesce("_seed.explicit", F.lit(0)) + F.col("_moved") - F.coalesce("_seed._moved", F.lit(0))
    return rows.where("needs").select(
        "doc_id",
        "idx",
        number.alias("number"),
        F.concat(number.cast("string"), F.lit(". "), F.col("stripped")).alias("new_text"),
    )


def autonumbered_notice(numbered: DataFrame) -> DataFrame:
    """One notice per manuscript with the number of entries that got a number."""
    rows = numbered.groupBy("doc_id").agg(F.count("*").alias("n"))
    return findings(
        rows,
        "bibliography_entries_autonumbered",
        "п. 6.16",
        status="auto_fixed",
        severity="info",
        description=F.concat(
            F.lit("Автоматически пронумерованы источники без номера: "), F.col("n").cast("string"), F.lit(".")
        ),
    )
