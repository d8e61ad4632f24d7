"""Text revision: normalised headings, spacing, edits, and reversals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley import rules as ru
from galley.align import edit_script
from galley.compose import states_before
from galley.functions import text as tx
from galley.operators.features import DOC
from galley.operators.structure import apply_text
from galley.scan import following, last, prev, running_max, running_sum, scan
from galley.session import stage

# Names set in capitals, appendix labels and markers, number prefixes.
CAPITAL_TITLES = (
    "введение", "заключение", "содержание", "список использованных источников",
    "список литературы", "список использованной литературы",
    "список использованных источников и литературы", "список используемой литературы",
    "список используемых источников", "библиографический список", "реферат", "приложение",
    "термины и определения", "перечень сокращений и обозначений",
    "список сокращений и условных обозначений", "перечень сокращений",
)
_APPENDIX_LABEL = r"(?iU)^\s*приложение\b"
_APPENDIX_MARKER = r"(?iU)^\s*\(?\s*(обязательн|справочн|рекомендуем|информацион)"
_STRICT_NUMBER = r"(?U)^(\d+(?:\.\d+)*)[.)]?\s+"
_FIGURE_LINE = r"(?iU)^\s*рисунок\s+\d+(?:\.\d+)*\s*[–—\-]\s*\S"
_LEADING_NUMBER = r"(?U)^\s*\d+(?:\.\d+)*"
_SWAP_NUMBER = r"(?U)^(\d+(?:\.\d+)*[.)]?\s+)"
_SWAP_CHAPTER = rf"(?iU)^(?:{'|'.join(tx.CHAPTER_WORDS)})\s+(?:\d+(?:\.\d+)*|[ivxlcdm]+)[.:\s]+"
_LIST_NUMBER = r"(?U)^(\d+(?:\.\d+){0,2})[.)]?\s*"
LABEL_LENGTH, CHAPTER_LINE = 40, 140
REVERTABLE = (
    "heading_recovered", "forbidden_heading", "long_table_split_warning",
    "table_mass_bold_removed", "citation_separator_missing", "paragraph_spacing",
    "font_size_inconsistency",
)
NEEDS_ORIGINAL = ("citation_separator_missing", "paragraph_spacing", "font_size_inconsistency")
_FOOTER = r"(?U)^\s*(\d{1,4})\s*$"
PREFIX_CUT, KEY_LENGTH, NEAR_LENGTH, CONTENTS_CUT = 20, 12, 12, 12
KEY_CLASSES = 1024


def starts_capital_title(norm: Column) -> Column:
    """Normalised text that starts with a name set in capitals."""
    return norm.rlike("^(?:" + "|".join(CAPITAL_TITLES) + ")")


def strip_chapter_word(rows: DataFrame, column: str = "text") -> DataFrame:
    """``Глава 1 Название`` becomes ``1 Название``; other texts stay."""
    prefix = rows.withColumn("_prefix", tx.heading_prefix(tx.strip_blank(F.col(column))))
    title, number = F.col("_prefix.title"), F.col("_prefix.number")
    bare = F.when(title != "", F.concat_ws(" ", number, title)).otherwise(number)
    chapter = tx.is_true(F.col("_prefix.kind") == "chapter_word")
    return prefix.withColumn(column, F.when(chapter, bare).otherwise(F.col(column))).drop("_prefix")


def normalise_heading_text(rows: DataFrame, column: str = "text") -> DataFrame:
    """Bring headings to their final form: number tidied, chapter word dropped, case settled.

    Works in named steps, so that each intermediate text is computed once.
    """
    text, lead, rest = F.col(column), F.col("_lead"), F.col("_rest")
    steps = strip_chapter_word(rows.withColumn(column, F.regexp_replace(text, r"(?U)^\s+", "")), column)
    flat = F.regexp_replace(F.regexp_replace(text, _STRICT_NUMBER, "$1 "), r"(?U)\s+", " ")
    steps = (
        steps.withColumn(column, F.regexp_replace(flat, r"\.+$", ""))
        .withColumn("_norm", tx.norm_text(text))
        .withColumn("_lead", F.regexp_extract(text, r"(?U)^([\d.]+\s+)", 1))
        .withColumn("_rest", text.substr(F.length("_lead") + 1, F.length(column)))
        .withColumn("_label", text.rlike(_APPENDIX_LABEL))
        .withColumn(
            "_words",
            F.filter(F.split(F.when(F.col("_label"), text).otherwise(rest), " "), lambda w: w != ""),
        )
        .withColumn("_cased", tx.sentence_case(F.col("_words")))
    )
    raised = F.concat(tx.upper(F.substring(rest, 1, 1)), rest.substr(F.lit(2), F.length(rest)))
    body = (
        F.when((rest == "") | ~rest.rlike(r"\p{L}"), rest)
        .when(tx.letters_all_upper(rest), F.col("_cased"))
        .when(tx.starts_lower(rest), raised)
        .otherwise(rest)
    )
    final = (
        F.when(F.col("_label"), F.col("_cased"))
        .when(starts_capital_title(F.col("_norm")), tx.upper(text))
        .otherwise(F.concat(lead, body))
    )
    return steps.withColumn(column, final).drop("_norm", "_lead", "_rest", "_label", "_words", "_cased")


def normalise_headings(headings: DataFrame, derived: bool = False) -> DataFrame:
    """New heading texts: doc_id, idx, new_text. With ``derived``, automatic numbers become text."""
    text = F.col("text")
    if derived:
        automatic = F.col("numpr_ilvl").isNotNull() & F.col("derived_number").isNotNull() & ~text.rlike(_LEADING_NUMBER)
        text = F.when(automatic, F.concat_ws(" ", "derived_number", text)).otherwise(text)
    return normalise_heading_text(headings.select("doc_id", "idx", text.alias("new_text")), "new_text")


def normalise_spaces(text: Column) -> Column:
    """Runs of spaces collapse, outer spaces go."""
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def space_changes(zoned: DataFrame, headings: DataFrame, code: DataFrame, skip: str = "in_title") -> DataFrame:
    """New text of body paragraphs with untidy spaces; headings and code are left alone."""
    new = normalise_spaces(F.col("text"))
    return (
        zoned.where(~F.col(skip) & (new != F.col("text")))
        .join(headings.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
        .join(code.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
        .select("doc_id", "idx", new.alias("new_text"))
    )


def chapter_word_changes(zoned: DataFrame, skip: str = "in_title") -> DataFrame:
    """Short paragraphs that start with a chapter word and number, without the word."""
    rows = zoned.where(
        ~F.col(skip)
        & (F.col("length") <= CHAPTER_LINE)
        & tx.is_true(F.col("prefix.kind") == "chapter_word")
    )
    return strip_chapter_word(rows.select("doc_id", "idx", F.col("stripped").alias("new_text")), "new_text")


def drop_empty_paragraphs(zoned: DataFrame, skip: str = "in_title") -> DataFrame:
    """Remove blank paragraphs and number the rest anew.

    Kept: images, section breaks, and the first blank after a table (seen as a
    step of more than one in ``elem_no`` from the paragraph before).
    """
    # The places are worked out on narrow rows, which the wide ones then meet once.
    narrow = zoned.select("doc_id", "idx", "elem_no", skip, "is_empty", "has_image", "has_section_break")
    rows = scan(narrow, DOC, ["elem_no"], _before=prev(F.col("elem_no")))
    after_table = F.col("elem_no") - F.coalesce("_before", F.lit(-1)) > 1
    removable = (
        ~F.col(skip) & F.col("is_empty") & ~F.col("has_image") & ~F.col("has_section_break") & ~after_table
    )
    kept = stage(rows.where(~removable).select("doc_id", "idx"), "kept-paragraphs")
    kept = scan(kept, DOC, ["idx"], _n=running_sum(F.lit(1))).select(F.col("doc_id").alias("_kd"), F.col("idx").alias("_ki"), "_n")
    rows = zoned.join(kept.hint("shuffle_hash"), (F.col("doc_id") == F.col("_kd")) & (F.col("idx") == F.col("_ki"))).drop("_kd", "_ki")
    return rows.withColumn("old_idx", F.col("idx")).withColumn("idx", (F.col("_n") - 1).cast("int")).drop("_n")


def one_blank_after_blocks(elements: DataFrame) -> DataFrame:
    """Body elements with exactly one blank paragraph after every table and figure caption.

    ``elements(doc_id, elem_no, kind, text, has_section_break)``; adds ``added``
    and the new order ``new_pos``.
    """
    blank = (F.col("kind") == "p") & (tx.strip_blank(F.coalesce("text", F.lit(""))) == "") & ~F.col("has_section_break")
    rows = scan(elements.withColumn("_blank", blank), DOC, ["elem_no"], _next=following(F.struct("_blank")))
    needs = ((F.col("kind") == "tbl") | F.col("text").rlike(_FIGURE_LINE)) & ~tx.is_true(F.col("_next._blank"))
    rows = rows.withColumn("_needs", tx.is_true(needs)).withColumn(
        "added", F.explode(F.when(F.col("_needs"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    )
    rows = rows.withColumn("_order", F.col("added").cast("int"))
    rows = scan(rows, DOC, ["elem_no", "_order"], _n=running_sum(F.lit(1)))
    return rows.select(
        "doc_id",
        "elem_no",
        F.when(F.col("added"), "p").otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("added"), "").otherwise(F.col("text")).alias("text"),
        "added",
        (F.col("_n") - 1).cast("long").alias("new_pos"),
    )


def page_break_plan(zoned: DataFrame, headings: DataFrame) -> DataFrame:
    """First-level headings that need a page break before them: doc_id, idx."""
    tops = headings.where("level = 1").select("doc_id", "idx", F.lit(True).alias("_top"))
    text = F.col("stripped")
    follows = ~F.col("has_page_break_before") & ~text.rlike(_APPENDIX_LABEL) & ~text.rlike(_APPENDIX_MARKER)
    rows = zoned.select("doc_id", "idx", "elem_no", follows.alias("_follows")).join(tops, ["doc_id", "idx"], "left")
    rows = scan(rows, DOC, ["elem_no"], _before=prev(F.struct("elem_no", "_follows")))
    return rows.where(
        F.col("_top") & (F.col("_before.elem_no") == F.col("elem_no") - 1) & F.col("_before._follows")
    ).select("doc_id", "idx")


def toc_outline(zoned: DataFrame, rules: dict) -> DataFrame:
    """Outline of the contents: headings by outline level, without the contents title."""
    return zoned.where(
        ~F.col("in_title")
        & ~F.col("norm").isin(ru.contents_names(rules))
        & F.col("outline_level").between(0, 2)
        & ~F.col("is_empty")
    ).select("doc_id", "idx", (F.col("outline_level") + 1).alias("level"), F.col("stripped").alias("text"))


def appendix_title_rows(zoned: DataFrame) -> DataFrame:
    """Title of every appendix: doc_id, label_idx, idx, new_text.

    The first non-empty paragraph after the label, or after one marker line
    such as “(обязательное)”, unless it is a section heading itself.
    """
    solid = zoned.where(~F.col("is_empty")).select("doc_id", "idx", "stripped")
    label = F.col("stripped").rlike(_APPENDIX_LABEL) & (F.length("stripped") < LABEL_LENGTH)
    # Lines are numbered without their texts; only the two after a label are looked up.
    lines = stage(scan(solid.select("doc_id", "idx", label.alias("_label")), DOC, ["idx"], _n=running_sum(F.lit(1))), "numbered-lines")
    after = lines.where("_label").select(
        "doc_id", F.col("idx").alias("label_idx"), "_n", F.explode(F.array(F.lit(1), F.lit(2))).alias("_step")
    )
    after = after.withColumn("_n", F.col("_n") + F.col("_step")).join(lines.select("doc_id", "_n", "idx"), ["doc_id", "_n"])
    near = solid.join(after.select("doc_id", "idx", "label_idx", "_step"), ["doc_id", "idx"])
    line = F.struct("idx", "stripped")
    one, two = F.max(F.when(F.col("_step") == 1, line)), F.max(F.when(F.col("_step") == 2, line))
    rows = near.groupBy("doc_id", "label_idx").agg(one.alias("_one"), two.alias("_two"))
    marked = F.col("_one.stripped").rlike(_APPENDIX_MARKER)
    rows = rows.select("doc_id", "label_idx", F.when(marked, F.col("_two")).otherwise(F.col("_one")).alias("t"))
    rows = rows.where(F.col("t").isNotNull() & ~starts_capital_title(tx.norm_text(F.col("t.stripped"))))
    words = F.col("t.stripped")
    raised = F.when(
        tx.starts_lower(words), F.concat(tx.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words)))
    ).otherwise(words)
    return rows.select("doc_id", "label_idx", F.col("t.idx").alias("idx"), raised.alias("new_text"))


def apply_paragraph_edits(paragraphs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply the latest edit per paragraph: (paragraphs, edits outside any manuscript).

    ``edits(doc_id, idx, new_text, edited_at)``.
    """
    latest = edits.groupBy("doc_id", "idx").agg(
        F.max_by(tx.strip_blank(F.col("new_text")), "edited_at").alias("new_text")
    )
    rejected = edits.join(paragraphs.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
    return apply_text(paragraphs, latest), rejected


def replace_heading_number(text: Column, number: Column, recorded: Column) -> Column:
    """Text with its leading number swapped, or null where there is none to swap."""
    lead = F.concat(F.regexp_replace(number, r"\.+$", ""), F.lit(" "))
    safe = F.replace(lead, F.lit("$"), F.lit(r"\$"))
    body = F.ltrim(text)
    given = tx.strip_blank(F.coalesce(recorded, F.lit("")))
    tail = body.substr(F.length(given) + 1, F.length(body))
    dotted = F.trim(F.substring(tail, 1, 2)).isin("", ".", ")")
    suffix = F.when(dotted, F.regexp_replace(tail, r"^[. ]+", "")).otherwise(tail)
    indent = F.substring(text, F.lit(1), F.length(text) - F.length(body))
    return (
        F.when(text.rlike(_SWAP_NUMBER), F.regexp_replace(text, F.lit(_SWAP_NUMBER), safe))
        .when(text.rlike(_SWAP_CHAPTER), F.regexp_replace(text, F.lit(_SWAP_CHAPTER), safe))
        .when((given != "") & F.startswith(body, given), F.concat(indent, lead, suffix))
    )


def promote_headings(paragraphs: DataFrame, actions: DataFrame) -> DataFrame:
    """Paragraphs turned into headings: doc_id, idx, level, new_text.

    ``actions(doc_id, idx, chosen_number, level)``; a number of one to three
    parts or none, a level of 1 to 3 or none.
    """
    number = tx.strip_blank(F.coalesce("chosen_number", F.lit("")))
    good = ((number == "") | number.rlike(r"(?U)^\d+(?:\.\d+){0,2}$")) & (
        F.col("level").isNull() | F.col("level").between(1, 3)
    )
    rows = paragraphs.select("doc_id", "idx", "text").join(actions.where(good), ["doc_id", "idx"])
    rows = normalise_heading_text(rows)
    norm = F.col("text")
    bare = F.ltrim(F.regexp_replace(norm, r"(?U)^\s*\d+(?:\.\d+){0,2}[.)]?\s+", ""))
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    return rows.select(
        "doc_id",
        "idx",
        F.coalesce("level", F.when(number != "", dots + 1).otherwise(1)).cast("int").alias("level"),
        F.when(number != "", F.rtrim(F.concat_ws(" ", number, bare))).otherwise(norm).alias("new_text"),
    )


def ensure_list_dot(text: Column) -> Column:
    """``1.2 Foo`` and ``1.2) Foo`` become ``1.2. Foo``."""
    digits = F.regexp_extract(text, _LIST_NUMBER, 1)
    rest = F.regexp_replace(text, _LIST_NUMBER, "")
    dotted = F.when(rest != "", F.concat(digits, F.lit(". "), F.ltrim(rest))).otherwise(
        F.concat(digits, F.lit("."))
    )
    return F.when(digits != "", dotted).otherwise(text)


def demote_headings(
    paragraphs: DataFrame, headings: DataFrame, actions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Headings turned into body text or list items: (headings left, text changes).

    ``actions(doc_id, idx, as_kind)`` with kind ``text`` or ``list``.
    """
    kept = headings.join(actions.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
    listed = actions.where("as_kind = 'list'").select("doc_id", "idx")
    changes = (
        paragraphs.select("doc_id", "idx", "text")
        .join(listed, ["doc_id", "idx"])
        .select("doc_id", "idx", ensure_list_dot(F.col("text")).alias("new_text"))
    )
    return kept, changes


def revert_captions(paragraphs: DataFrame, reverted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give captions their original text back: (text changes, findings marked rejected).

    ``reverted(finding_id, doc_id, original_text, fixed_text)``. The first
    paragraph that reads like the fixed text is taken; the finding is rejected
    even if there is none.
    """
    wanted = reverted.select(
        "finding_id",
        "doc_id",
        tx.strip_blank(F.col("fixed_text")).alias("_fixed"),
        tx.strip_blank(F.col("original_text")).alias("_original"),
    )
    lines = paragraphs.select("doc_id", "idx", tx.strip_blank(F.col("text")).alias("_fixed"))
    found = (
        lines.join(wanted, ["doc_id", "_fixed"])
        .groupBy("doc_id", "finding_id", "_original")
        .agg(F.min("idx").alias("idx"))
    )
    changes = found.groupBy("doc_id", "idx").agg(F.min_by("_original", "finding_id").alias("new_text"))
    return changes, reverted.withColumn("status", F.lit("rejected"))


def revert_auto_fixes(revised: DataFrame, original: DataFrame, reverted: DataFrame) -> DataFrame:
    """Undo automatic fixes by type, taking values from the original paragraphs.

    ``reverted(doc_id, type, paragraph_index, original_text)``. Paragraph-level
    types change one paragraph, ``paragraph_spacing`` and
    ``font_size_inconsistency`` all paragraphs that both versions have.
    """
    kinds = reverted.where(F.col("type").isin(*REVERTABLE))
    single = kinds.where("paragraph_index IS NOT NULL").groupBy(
        F.col("doc_id").alias("_d"), F.col("paragraph_index").alias("_i")
    ).agg(
        F.max(F.col("type") == "heading_recovered").alias("_body"),
        F.max(F.when(F.col("type") == "forbidden_heading", F.nullif(tx.strip_blank(F.col("original_text")), F.lit("")))).alias("_old_title"),
        F.max(F.col("type") == "citation_separator_missing").alias("_old_text"),
    )
    whole = kinds.groupBy(F.col("doc_id").alias("_wd")).agg(
        F.max(F.col("type") == "paragraph_spacing").alias("_spacing"),
        F.max(F.col("type") == "font_size_inconsistency").alias("_size"),
    )
    old = original.select(
        F.col("doc_id").alias("_od"), F.col("idx").alias("_oi"), F.col("text").alias("_otext"),
        F.col("space_before_pt").alias("_obefore"), F.col("space_after_pt").alias("_oafter"),
        F.col("max_font_size_pt").alias("_osize"),
    )
    rows = (
        revised.join(single, (F.col("doc_id") == F.col("_d")) & (F.col("idx") == F.col("_i")), "left")
        .join(whole, F.col("doc_id") == F.col("_wd"), "left")
        .join(old, (F.col("doc_id") == F.col("_od")) & (F.col("idx") == F.col("_oi")), "left")
    )
    known, body = F.col("_oi").isNotNull(), tx.is_true(F.col("_body"))
    spacing, size = tx.is_true(F.col("_spacing")) & known, tx.is_true(F.col("_size")) & known
    new = {
        "text": F.when(tx.is_true(F.col("_old_text")) & known, F.col("_otext"))
        .when(F.col("_old_title").isNotNull(), F.col("_old_title"))
        .otherwise(F.col("text")),
        "space_before_pt": F.when(spacing, F.col("_obefore")).otherwise(F.col("space_before_pt")),
        "space_after_pt": F.when(spacing, F.col("_oafter")).otherwise(F.col("space_after_pt")),
        "max_font_size_pt": F.when(size, F.coalesce("_osize", "max_font_size_pt")).otherwise(F.col("max_font_size_pt")),
        "style_name": F.when(body, "Normal").otherwise(F.col("style_name")),
        "outline_level": F.when(body, None).otherwise(F.col("outline_level")),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in revised.columns])


def keep_list_numbers(numbered: DataFrame, headings: DataFrame, skip: str = "in_title") -> DataFrame:
    """Body paragraphs whose automatic number becomes text: doc_id, idx, new_text."""
    return (
        numbered.where(
            ~F.col(skip)
            & ~F.col("is_empty")
            & F.col("numpr_num_id").isNotNull()
            & F.col("derived_number").isNotNull()
            & ~F.col("text").rlike(_LEADING_NUMBER)
        )
        .join(headings.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti")
        .select("doc_id", "idx", F.concat(F.col("derived_number"), F.lit(". "), F.ltrim("text")).alias("new_text"))
    )


def revision_diff(original: DataFrame, revised: DataFrame, context: int = 3) -> DataFrame:
    """Changed paragraphs with ``context`` lines around, in hunks, as a unified diff has them.

    Both frames have (doc_id, idx, text); ``idx`` only orders the paragraphs of its own frame. Returns doc_id, hunk
    (from 1), place (order in the diff), old_no and new_no (places from 0 in the two versions, null where the line is
    not in one), op (' ', '-' or '+') and text. A document that only one frame has is removed or added as a whole.
    """
    def numbered(frame, name):
        rows = scan(frame.select("doc_id", "idx", "text"), DOC, ["idx"], _no=running_sum(F.lit(1)))
        return stage(rows.select("doc_id", (F.col("_no") - 1).alias(name), F.coalesce("text", F.lit("")).alias("text")), "numbered-lines")

    rows = stage(edit_script(numbered(original, "i"), numbered(revised, "j")), "edit-script")
    changed = F.col("op") != " "
    # A line is near if at most ``context`` equal lines, itself included, lie between it and a change.
    past = F.col("i") + (F.col("op") == "-").cast("int")
    rows = scan(rows, DOC, ["place"], _before=last(F.when(changed, past)), _after=following(F.when(changed, F.col("i"))))
    near = changed | (F.col("i") - F.col("_before") < context) | (F.col("_after") - F.col("i") <= context)
    rows = stage(rows.where(tx.is_true(near)), "near-changes")
    done = F.col("i") + F.col("j") + F.when(changed, 1).otherwise(2)
    rows = scan(rows, DOC, ["place"], _prev=prev(done))
    rows = stage(rows.withColumn("_opens", F.col("_prev").isNull() | (F.col("place") != F.col("_prev"))), "hunk-starts")
    rows = scan(rows, DOC, ["place"], hunk=running_sum(F.col("_opens").cast("long")))
    return rows.select(
        "doc_id", "hunk", "place", F.when(F.col("op") != "+", F.col("i")).alias("old_no"),
        F.when(F.col("op") != "-", F.col("j")).alias("new_no"), "op", "text",
    )


def page_lines(pages: DataFrame) -> DataFrame:
    """Lines of rendered pages: doc_id, page_no, line_no, line, squashed."""
    return pages.select(
        "doc_id", "page_no", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line")
    ).withColumn("squashed", tx.squash_text(F.col("line")))


def heading_pages(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """Printed page of every outline entry: doc_id, idx, page (null: not found).

    A heading is looked for from the page of the heading before on; contents
    pages are skipped. The printed number is the physical page plus the
    commonest distance to the page's footer number, and never decreases.
    Manuscripts of a single page have nothing to look up.
    """
    # Every step below reads the lines again: written once, with the footer's number instead of the line.
    footer = F.regexp_extract("line", _FOOTER, 1)
    lines = page_lines(pages).select("doc_id", "page_no", "line_no", "squashed", F.when(F.col("line").rlike(_FOOTER), footer).alias("footer"))
    lines = stage(lines, "page-lines")
    page_info = lines.groupBy("doc_id", "page_no").agg(
        tx.is_true(
            F.min_by(F.substring("squashed", 1, CONTENTS_CUT), F.when(F.col("squashed") != "", F.col("line_no"))).rlike("^(содержание|оглавление)")
        ).alias("is_contents"),
        F.max_by("footer", F.when(F.col("footer").isNotNull(), F.col("line_no"))).try_cast("long").alias("footer"),
    )
    page_info = stage(page_info, "page-info")
    several = page_info.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    entries = outline.select("doc_id", "idx", tx.squash_text(F.col("text")).alias("wanted")).where("wanted <> ''")
    found = _matching_pages(lines.drop("footer"), entries.join(several, "doc_id", "left_semi"))
    found = found.join(page_info.where("NOT is_contents"), ["doc_id", "page_no"], "left_semi")
    picked = stage(_first_pages(found), "picked-pages")
    offsets = (
        picked.join(page_info.select("doc_id", "page_no", "footer"), ["doc_id", "page_no"])
        .where("footer IS NOT NULL")
        .groupBy("doc_id", (F.col("footer") - F.col("page_no")).alias("offset"))
        .agg(F.count("*").alias("n"), F.min("idx").alias("first"))
        .groupBy("doc_id")
        .agg(F.max_by("offset", F.struct(F.col("n"), -F.col("first"))).alias("offset"))
    )
    printed = picked.join(offsets, "doc_id", "left").withColumn(
        "_page", F.greatest(F.col("page_no") + F.coalesce("offset", F.lit(0)), F.lit(1))
    )
    rising = scan(printed, DOC, ["idx"], page=running_max(F.col("_page")))
    return outline.select("doc_id", "idx").join(rising.select("doc_id", "idx", "page"), ["doc_id", "idx"], "left")


def _matching_pages(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages with a line that reads like the entry: doc_id, idx, page_no.

    Lines and entries meet on the entry's first twelve characters, or all of a
    shorter one. They are looked for at the start of the line or, in lines short
    enough to hold the entry with at most 12 characters more, at one of its first
    13 places, in the lengths that the manuscript's entries have. Of the many
    pieces of a line only its place travels, and its text follows for pieces
    that are some entry's key.
    """
    key_length = F.least(F.length("wanted"), F.lit(KEY_LENGTH))
    entries = stage(entries.withColumn("_key", F.substring("wanted", F.lit(1), key_length)), "wanted-headings")
    numbered, number = entries.withColumn("_key", F.xxhash64("_key")), F.xxhash64("_key")
    lines, place = lines.where("squashed <> ''"), ["doc_id", "page_no", "line_no"]
    pieces = _line_pieces(lines, entries).withColumn("_key", number)
    met = pieces.join(numbered.select("doc_id", "_key").distinct().hint("merge"), ["doc_id", "_key"], "left_semi")
    keyed = met.join(lines.hint("merge"), place).select("doc_id", "page_no", "squashed", "_key")
    line, entry = F.col("squashed"), F.col("wanted")
    same = F.startswith(line, entry)
    wrapped = (F.length("squashed") >= KEY_LENGTH) & F.startswith(entry, line)
    inside = F.contains(line, entry) & (F.length("squashed") <= F.length("wanted") + NEAR_LENGTH)
    # A line that begins with a longer piece of the entry begins with the shortest one, too.
    cut = (F.length("wanted") > PREFIX_CUT) & F.startswith(line, F.substring("wanted", 1, PREFIX_CUT))
    return (
        keyed.join(numbered, ["doc_id", "_key"])
        .where(same | wrapped | inside | cut)
        .select("doc_id", "idx", "page_no")
        .distinct()
    )


def _line_pieces(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Pieces of lines that may be the key of an entry, by place: doc_id, page_no, line_no, _key.

    The classes that the keys of a manuscript fall in, of a fixed number, keep most other pieces from travelling.
    """
    key_class = F.pmod(F.xxhash64("_key"), F.lit(KEY_CLASSES)).cast("int")
    kept = entries.groupBy("doc_id").agg(
        F.max(F.length("wanted")).alias("_longest"), F.collect_set(F.length("_key")).alias("_lengths"),
        F.collect_set(key_class).alias("_classes"),
    )
    short = F.length("squashed") <= F.col("_longest") + NEAR_LENGTH
    offsets = F.when(short, F.sequence(F.lit(1), F.lit(NEAR_LENGTH + 1))).otherwise(F.array(F.lit(1)))
    keys = F.flatten(F.transform(offsets, lambda at: F.transform("_lengths", lambda n: F.substring(F.col("squashed"), at, n))))
    pieces = lines.join(kept, "doc_id").select("doc_id", "page_no", "line_no", "_classes", F.explode(F.array_distinct(keys)).alias("_key"))
    return pieces.where(F.array_contains("_classes", key_class)).drop("_classes")


def _first_pages(found: DataFrame) -> DataFrame:
    """Page of every entry, going through the entries in order: the first one with a match that is not before the
    page of the entry before. An entry without such a page has none and leaves the place as it is.

    An entry is a step function of the page reached before it; these are composed over blocks of entries.
    """
    entries = stage(
        found.groupBy("doc_id", "idx").agg(F.sort_array(F.collect_list(F.col("page_no").cast("long"))).alias("upto"))
        .select("doc_id", F.col("idx").cast("long").alias("place"), "upto", F.col("upto").alias("gives")),
        "heading-pages",
    )
    reached = states_before(entries, "doc_id", 0)
    return (
        entries.join(reached, ["doc_id", "place"])
        .select("doc_id", F.col("place").alias("idx"), F.array_min(F.filter("upto", lambda page: page >= F.col("before"))).alias("page_no"))
        .where("page_no IS NOT NULL")
    )


def page_numbers_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Manuscripts whose outline pages differ between two runs: doc_id, changed entries.

    ``before``/``after(doc_id, idx, page)`` list the pages in outline order; a
    manuscript known to only one run is not compared.
    """
    def ordered(frame, name):
        return scan(frame, DOC, ["idx"], place=running_sum(F.lit(1))).select(
            "doc_id", "place", F.struct("page").alias(name)
        )

    both = before.select("doc_id").distinct().join(after.select("doc_id").distinct(), "doc_id")
    rows = ordered(before, "a").join(ordered(after, "b"), ["doc_id", "place"], "full").join(both, "doc_id", "left_semi")
    return rows.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("doc_id").agg(F.count("*").alias("changed"))
