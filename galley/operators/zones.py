"""Which part of the manuscript a paragraph belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import rules as ru
from galley.functions import text as tx
from galley.operators.features import DOC
from galley.scan import last, prev, scan
from galley.session import stage

TITLE_SCAN, TITLE_MAX = 60, 25

# Patterns of contents lines, chapter starts and numbered starts.
_LEADER = (
    r"(?U)\.{3,}\s*\d+\s*\.?\s*$|\t\s*\d{1,3}\s*\.?\s*$"
    r"|\s{3,}\d{1,3}\s*\.?\s*$|[—–-]\s*\d{1,3}\s*\.?\s*$"
)
_CONTENTS_STYLE = r"(?iU)^(?:toc|оглавление|содержание)\s*\d*$"
_CHAPTER_START = rf"(?iU)^(?:{'|'.join(tx.CHAPTER_WORDS)})\s+\d+"
_FIRST_LEVEL = r"(?U)^\d+[.)]?\s+\S"
_NUMBER_START = r"(?U)^\d+[\.\d]*[\.\)]\s"
_TEN_SMALL = r"^\P{Ll}*+(?:\p{Ll}\P{Ll}*+){10}"

# Fonts of source code, and what a line of code looks like.
MONO_FONTS = (
    "courier new", "courier", "consolas", "cascadia code", "cascadia mono",
    "lucida console", "lucida sans typewriter", "monaco", "menlo",
    "dejavu sans mono", "liberation mono", "jetbrains mono", "fira code",
    "fira mono", "source code pro", "roboto mono", "ibm plex mono",
)
_KEYWORDS = (
    r"(?:def|class|import|from|return|if|elif|else|for|while|try|except|with"
    r"|const|let|var|function|public|private|protected|static|SELECT|INSERT|UPDATE|DELETE)\b"
)
CODE_KEYWORD = rf"(?iU)^\s*{_KEYWORDS}|[{{}}]"
CODE_LIKE = rf"(?iU)^\s*{_KEYWORDS}|[{{}}]|\w+\s*\([^)]*\)"
NUMBERED_LINE = r"(?U)^\s*\d+\s*[.)\]]?\s"
LISTING_START = r"(?iU)^\s*листинг\b"

# Word stems that mark a list of sources.
SOURCE_STEMS = ("источник", "литератур", "библиограф")


def title_page_end(features: DataFrame, rules: dict) -> DataFrame:
    """First paragraph after the title page per manuscript (0: no title page)."""
    solid, idx = ~F.col("is_empty"), F.col("idx")
    near = solid & (idx < TITLE_SCAN)
    norm = F.when(idx < TITLE_SCAN, F.col("norm"))
    marker = tx.any_of([norm.contains(m) for m in ru.title_markers(rules)])
    context = tx.any_of([norm.contains(m) for m in ru.TITLE_CONTEXT])
    boundary = solid & (
        tx.is_name(ru.aliases(rules, "contents", "introduction"))
        | F.col("stripped").rlike(_FIRST_LEVEL)
        | F.col("stripped").rlike(_CHAPTER_START)
        | tx.is_true(F.col("outline_level") == 0)
        | tx.is_true(F.col("numpr_ilvl") == 0)
    )
    centred = tx.is_true(F.col("alignment") == "center") & (F.col("length") <= 120)
    per_doc = features.groupBy("doc_id").agg(
        F.max(near & marker).alias("marked"),
        F.sum((near & centred).cast("long")).alias("centred"),
        F.sum((near & context).cast("long")).alias("context"),
        F.min(F.when(boundary, idx)).alias("boundary"),
        (F.max("idx") + 1).alias("paragraphs"),
    )
    titled = F.col("marked") | ((F.col("centred") >= 4) & (F.col("context") >= 2))
    end = F.coalesce("boundary", F.least("paragraphs", F.lit(TITLE_MAX)))
    return per_doc.select(
        "doc_id", F.when(titled, end).otherwise(0).cast("int").alias("title_end"), "paragraphs"
    )


def is_contents_line() -> Column:
    """Contents line: by style, page reference, leader dots, tab, wide gap or dash."""
    text = F.col("stripped")
    styled = F.lower(tx.strip_blank(F.col("style_name"))).rlike(_CONTENTS_STYLE)
    linked = F.col("has_page_reference") & (text != "") & (F.length("stripped") < 200)
    return styled | linked | (tx.ends_with_number(text) & text.rlike(_LEADER))


def is_structural_boundary(rules: dict) -> Column:
    """Heading by style or outline, section name, chapter, appendix, or short capitals."""
    text = F.col("stripped")
    styled = F.lower(tx.strip_blank(F.col("style_name"))).rlike(r"(?U)^(heading|заголовок)\s*[1-3]$")
    tests = [
        styled,
        tx.is_true(F.col("outline_level").between(0, 2)),
        tx.is_name(ru.all_aliases(rules)),
        text.rlike(_CHAPTER_START),
        (F.length("stripped") <= 80) & tx.letters_all_upper(text),
    ]
    appendix = ru.appendix_pattern(rules)
    if appendix:
        tests.append(text.rlike(appendix))
    return (text != "") & tx.any_of(tests)


def is_body_paragraph() -> Column:
    """Long running text: not capitals, not a chapter, not numbered."""
    text = F.col("stripped")
    return (
        (F.length("stripped") >= 80)
        & ~tx.letters_all_upper(text)
        & ~text.rlike(_CHAPTER_START)
        & ~text.rlike(_NUMBER_START)
        & text.rlike(_TEN_SMALL)
    )


def contents_lines(features: DataFrame, rules: dict) -> DataFrame:
    """Paragraphs of a typed table of contents: doc_id, idx, phase.

    Three readings, the first that finds anything wins: lines with leaders or
    page numbers; lines repeated word for word further down; lines up to the
    first real heading, body paragraph or table.
    """
    heads = (
        features.where(tx.is_name(ru.contents_names(rules)))
        .groupBy(F.col("doc_id").alias("_d"))
        .agg(F.min("idx").alias("head"))
    )
    # Texts do not travel, only what is asked of them and a digest that tells repeated ones.
    narrow = features.select(
        "doc_id",
        "idx",
        F.when(~F.col("is_empty"), F.unhex(F.md5("norm"))).alias("norm"),
        "is_empty",
        "table_follows",
        is_contents_line().alias("entry"),
        is_structural_boundary(rules).alias("structural"),
        is_body_paragraph().alias("body"),
    )
    after = stage(
        narrow.join(heads, (F.col("doc_id") == F.col("_d")) & (F.col("idx") >= F.col("head"))).drop("_d"), "contents-rows"
    )
    repeats = (
        after.where(~F.col("is_empty"))
        .groupBy(F.col("doc_id").alias("_d"), F.col("norm").alias("_n"))
        .agg(F.max("idx").alias("last_idx"))
    )
    after = after.join(
        repeats, (F.col("doc_id") == F.col("_d")) & (F.col("norm") == F.col("_n")), "left"
    ).drop("_d", "_n")
    below = F.col("idx") > F.col("head")
    unrepeated = F.col("is_empty") | (F.col("last_idx") <= F.col("idx"))
    limits = after.groupBy("doc_id").agg(
        F.min(F.when(below & F.col("entry"), F.col("idx"))).alias("first_entry"),
        F.min(F.when(below & unrepeated, F.col("idx"))).alias("unrepeated_at"),
        F.least(
            F.min(F.when(below & (F.col("structural") | F.col("body")), F.col("idx"))),
            F.min(F.when(F.col("table_follows"), F.col("idx"))),
        ).alias("boundary"),
    )
    after = after.join(limits.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d")).drop("_d")
    breaks = (
        after.where("idx > first_entry AND NOT entry AND NOT is_empty")
        .groupBy(F.col("doc_id").alias("_d"))
        .agg(F.min("idx").alias("entries_end"))
    )
    after = after.join(breaks, F.col("doc_id") == F.col("_d"), "left").drop("_d").where(below)
    manual = F.coalesce("unrepeated_at", F.col("head")) - F.col("head") > 2
    by_leader = (
        F.col("first_entry").isNotNull()
        & F.col("entry")
        & (F.col("entries_end").isNull() | (F.col("idx") < F.col("entries_end")))
    )
    by_repetition = F.col("first_entry").isNull() & manual & (F.col("idx") < F.col("unrepeated_at"))
    by_region = (
        F.col("first_entry").isNull() & ~manual & (F.col("idx") < F.col("boundary")) & ~F.col("structural")
    )
    phase = F.when(by_leader, 1).when(by_repetition, 2).when(by_region, 3)
    return after.select("doc_id", "idx", phase.alias("phase")).where("phase IS NOT NULL")


def mark_zones(features: DataFrame, rules: dict, onto: DataFrame | None = None) -> DataFrame:
    """Add ``in_title``, ``in_contents`` and their union ``skip`` to ``onto`` or ``features``."""
    if onto is None:
        # The marks of narrow rows, so that the wide ones move once.
        return with_marks(features, mark_zones(features, rules, onto=features.select("doc_id", "idx")))
    rows = onto
    titles = title_page_end(features, rules).select(F.col("doc_id").alias("_d"), "title_end")
    # Few lines, found in several passes: written before they meet the wide rows.
    lines = stage(contents_lines(features, rules).select("doc_id", "idx"), "contents-lines").select(
        F.col("doc_id").alias("_ld"), F.col("idx").alias("_li"), F.lit(True).alias("_line")
    )
    return (
        rows.join(titles, F.col("doc_id") == F.col("_d"), "left")
        .join(lines, (F.col("doc_id") == F.col("_ld")) & (F.col("idx") == F.col("_li")), "left")
        .select(
            *rows.columns,
            (F.col("idx") < F.col("title_end")).alias("in_title"),
            F.col("_line").isNotNull().alias("in_contents"),
        )
        .withColumn("skip", F.col("in_title") | F.col("in_contents"))
    )


def with_marks(features: DataFrame, marks: DataFrame) -> DataFrame:
    """Add ``marks(doc_id, idx, …)``; they are the hashed side, so that the wide rows are not sorted."""
    marks = marks.withColumnsRenamed({"doc_id": "_md", "idx": "_mi"}).hint("shuffle_hash")
    return features.join(marks, (F.col("doc_id") == F.col("_md")) & (F.col("idx") == F.col("_mi")), "left").drop("_md", "_mi")


def outside(rows: DataFrame, marks: DataFrame, skip: str = "in_title") -> DataFrame:
    """``rows(doc_id, idx, …)`` of paragraphs that ``marks`` does not have in the zone ``skip``; only the zone's own rows move."""
    return rows.where("doc_id IS NOT NULL").join(marks.where(skip).select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")


def references_start(features: DataFrame, rules: dict) -> DataFrame:
    """Paragraph that opens the list of sources."""
    # A letter that all stems have, large or small: without it, the norm is not worked out.
    letter = min(set.intersection(*map(set, SOURCE_STEMS)))
    norm = F.when(F.contains("stripped", F.lit(letter)) | F.contains("stripped", F.lit(letter.upper())), F.col("norm"))
    by_stem = tx.is_true((F.length(norm) < 80) & tx.any_of([norm.contains(s) for s in SOURCE_STEMS]))
    opens = ~F.col("is_empty") & (tx.is_name(ru.aliases(rules, "references")) | by_stem)
    # Not filtered by what opens a list: a filter would work out the norm once for each of its tests.
    return features.groupBy("doc_id").agg(F.min(F.when(opens, F.col("idx"))).alias("heading_idx")).where("heading_idx IS NOT NULL")


def references_range(features: DataFrame, headings: DataFrame, rules: dict) -> DataFrame:
    """Range [start, end) of the source list; ``end`` null means up to the last paragraph."""
    at = headings.select(F.col("doc_id").alias("_d"), F.col("idx").alias("_i"))
    later = F.when(F.col("_i") > F.col("heading_idx"), F.col("_i"))
    return (
        references_start(features, rules)
        .join(at, F.col("doc_id") == F.col("_d"), "left")
        .groupBy("doc_id", (F.col("heading_idx") + 1).alias("start"))
        .agg(F.min(later).alias("end"))
    )


def chapter_breaks(headings: DataFrame) -> DataFrame:
    """First-level headings with a leading whole number."""
    first = r"(?U)^(\d+)\b"
    number = F.coalesce(
        F.nullif(F.regexp_extract(F.coalesce("derived_number", F.lit("")), first, 1), F.lit("")),
        F.nullif(F.regexp_extract("text", first, 1), F.lit("")),
    )
    return headings.where("level = 1").select(
        "doc_id", "idx", number.try_cast("long").alias("chapter")
    ).where("chapter IS NOT NULL")


def with_chapters(paragraphs: DataFrame, breaks: DataFrame) -> DataFrame:
    """Add ``chapter``, the last break at or before the paragraph (0 before the first)."""
    at = breaks.select(F.col("doc_id").alias("_d"), F.col("idx").alias("_i"), F.col("chapter").alias("_c"))
    joined = paragraphs.join(at, (F.col("doc_id") == F.col("_d")) & (F.col("idx") == F.col("_i")), "left").drop("_d", "_i")
    filled = scan(joined, DOC, ["idx"], chapter=last(F.col("_c")))
    return filled.withColumn("chapter", F.coalesce("chapter", F.lit(0))).drop("_c")


def is_code_line() -> Column:
    """Line of source code, judged by fonts, numbering and keywords."""
    text = F.col("stripped")
    fonts = F.filter(F.col("run_fonts"), lambda f: f != "")
    mono = (F.size(fonts) > 0) & F.forall(
        fonts, lambda f: F.lower(F.trim(f)).isin(list(MONO_FONTS))
    )
    numbered = text.rlike(NUMBERED_LINE)
    rest = F.regexp_replace(text, NUMBERED_LINE, "")
    mono_code = F.col("text").rlike("^[ \t]") | numbered | text.rlike(CODE_LIKE)
    plain_code = F.when(numbered, rest.rlike(CODE_KEYWORD)).otherwise(text.rlike(CODE_KEYWORD))
    return (
        (text != "")
        & ~text.rlike(LISTING_START)
        & F.when(mono, mono_code).otherwise(plain_code)
    )


def listing_code_lines(zoned: DataFrame, skip: str = "in_title") -> DataFrame:
    """Lines of code under a listing caption, up to the first other text."""
    stop = F.col(skip) | (~F.col("is_empty") & ~F.col("_code"))
    opens = ~F.col(skip) & F.col("stripped").rlike(LISTING_START)
    rows = zoned.withColumn("_code", is_code_line()).select("doc_id", "idx", skip, "_code", F.when(stop, opens).alias("_opens"))
    rows = scan(rows, DOC, ["idx"], _open=prev(F.col("_opens")))
    return rows.where(
        F.col("_open") & F.col("_code") & ~F.col(skip)
    ).select("doc_id", "idx")
