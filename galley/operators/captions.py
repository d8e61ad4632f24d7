"""Captions of figures, tables and listings, and references to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import text as tx
from galley.operators.features import DOC
from galley.operators.zones import chapter_breaks, is_code_line, outside, with_marks
from galley.scan import following, last, prev, running_sum, scan
from galley.schema import findings
from galley.session import stage

# Caption words, and phrases that refer to a figure or a table.
WORDS = {"figure": "Рисунок", "table": "Таблица", "listing": "Листинг"}
_BLANK = "[ " + chr(0xA0) + "]"
_NUMBER = r"\d+(?:\.\d+)*"
REFERENCE = (
    r"(?iU)(рисунок|рисунк\w*|рис\.?|таблица|таблиц\w*|табл\.?)"
    rf"([№ {chr(0xA0)}]*)"
    rf"({_NUMBER}(?:{_BLANK}*(?:,|и){_BLANK}*{_NUMBER})*)"
)
_CONTINUED = r"(?iU)^\s*(продолжение|окончание)\s+таблиц"
_APPENDIX_LETTER = r"(?iU)^приложение\s+([а-яё])\b"
_TABLE_CAPTION_START = r"(?iU)^(таблица|табл\.)\s+\d+(?:\.\d+)*(?:\s*[:–—-]\s*|\.\s+)\S"
_TITLE_EDGE = r"^[ –—\-:.,]+|[ –—\-:.,]+$"
_LOOSE_TITLE_EDGE = r"^[ –—\-,]+|[ –—\-,]+$"
BOOKMARKS = {"figure": "_Ref_fig", "table": "_Ref_tbl"}


def _patterns(kind: str) -> tuple[str, str, str]:
    """(start, explicit separator, number and title) for a kind of caption."""
    word = WORDS[kind]
    if kind == "listing":
        return (
            rf"(?iU)^{word}\b",
            rf"(?iU)^{word}\s*(?:{_NUMBER})?(?:\s*[:–—-]\s*|\.\s+)\S",
            rf"(?iUd)^{word}\s*({_NUMBER})?\s*[:.–—\-]?\s*(.*)$",
        )
    return (
        rf"(?iU)^{word}\s+[\d–—\-]",
        rf"(?iU)^{word}\s+{_NUMBER}(?:\s*[:–—-]\s*|\.\s+)\S",
        rf"(?iUd)^{word}\s+({_NUMBER})\s*[:.–—\-]?\s*(.*)$",
    )


def caption_rows(zoned: DataFrame, kind: str, skip: str = "in_title", marks: DataFrame | None = None) -> DataFrame:
    """Paragraphs that are captions of ``kind``: doc_id, idx, original number, title, text.

    An explicit separator settles it. Without one, a figure or listing caption
    must be centred or follow an image, and a table caption must not end like
    a sentence. A table caption stands right before a table, a listing caption
    right before code. ``marks`` are taken where the paragraphs have no zones themselves.
    """
    start, separator, number_title = _patterns(kind)
    text = F.col("stripped")
    listing = kind == "listing"
    # Of the texts, only those that begin like a caption move.
    columns = ["doc_id", "idx", F.when(text.rlike(start), text).alias("stripped"), "alignment", "has_image", "is_empty", "next_is_table"]
    rows = zoned.select(
        *columns, *([is_code_line().alias("_code")] if listing else []), *([F.col(skip).alias("_skip")] if marks is None else [])
    )
    if marks is not None and listing:
        rows = with_marks(rows, marks.select("doc_id", "idx", F.col(skip).alias("_skip")))
    steps = {}
    if kind != "table":
        shown = F.when(F.col("has_image") | ~F.col("is_empty"), F.col("has_image"))
        steps["_image_above"] = prev(shown)
    if listing:
        steps["_code_below"] = following(
            F.when(F.col("_skip") | ~F.col("is_empty"), F.col("_code") & ~F.col("_skip"))
        )
    if steps:
        rows = scan(rows, DOC, ["idx"], **steps)
    real = text.rlike(separator)
    if kind == "table":
        real = F.col("next_is_table") & (real | ~text.rlike(r"[.!?]$"))
    else:
        centred = tx.is_true(F.col("alignment") == "center")
        real = real | centred | tx.is_true(F.col("_image_above"))
    if listing:
        real = real & tx.is_true(F.col("_code_below")) & ~text.rlike(_APPENDIX_LETTER)
    parsed = text.rlike(number_title)
    title = F.regexp_replace(F.regexp_extract(text, number_title, 2), _TITLE_EDGE, "")
    after_word = F.regexp_replace(text, r"^[^ ]* ", "")
    found = rows.where(text.isNotNull() & real)
    found = outside(found, marks, skip) if marks is not None and not listing else found.where(~F.col("_skip"))
    return found.select(
        "doc_id",
        "idx",
        F.nullif(F.regexp_extract(text, number_title, 1), F.lit("")).alias("original_number"),
        F.when(parsed, title)
        .otherwise(F.regexp_replace(after_word, _LOOSE_TITLE_EDGE, ""))
        .alias("title"),
        text.alias("text"),
    )


def chapter_segments(breaks: DataFrame) -> DataFrame:
    """Breaks at which the chapter really changes: doc_id, idx, chapter."""
    rows = scan(breaks, DOC, ["idx"], _before=prev(F.col("chapter")))
    return rows.where(F.coalesce("_before", F.lit(0)) != F.col("chapter")).drop("_before")


def _place(captions: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """Add to each caption the position and value of the last mark at or before it."""
    both = captions.select("doc_id", "idx", F.lit(None).cast(marks.schema[value].dataType).alias("_value"), F.lit(True).alias("_caption")).unionByName(
        marks.select("doc_id", "idx", F.col(value).alias("_value"), F.lit(False).alias("_caption"))
    )
    both = both.withColumn("_kind", F.when(F.col("_caption"), 1).otherwise(0))
    mark = F.when(~F.col("_caption"), F.struct(F.col("idx").alias("at"), F.col("_value").alias("value")))
    placed = scan(both, DOC, ["idx", "_kind"], _mark=last(mark)).where("_caption")
    return captions.join(placed.select("doc_id", "idx", "_mark"), ["doc_id", "idx"], "left")


def appendix_marks(zoned: DataFrame, skip: str = "in_title", marks: DataFrame | None = None) -> DataFrame:
    letter = F.regexp_extract("stripped", _APPENDIX_LETTER, 1)
    rows = zoned.where(~F.col(skip)) if marks is None else zoned
    rows = rows.where(letter != "").select("doc_id", "idx", F.upper(letter).alias("letter"))
    return rows if marks is None else outside(rows, marks, skip)


def number_captions(
    captions: DataFrame, breaks: DataFrame | None, appendices: DataFrame | None = None
) -> DataFrame:
    """Add ``new_number``: by chapter where ``breaks`` is given, else continuous.

    With ``appendices`` the captions after an appendix heading get its letter
    and a counter of their own, and do not move the main counter.
    """
    rows = captions
    if breaks is None:
        rows = rows.withColumn("_at", F.lit(-1)).withColumn("_chapter", F.lit(0).cast("long"))
    else:
        rows = _place(rows, chapter_segments(breaks), "chapter")
        rows = (
            rows.withColumn("_at", F.coalesce("_mark.at", F.lit(-1)))
            .withColumn("_chapter", F.coalesce("_mark.value", F.lit(0)))
            .drop("_mark")
        )
    if appendices is None:
        rows = rows.withColumn("_letter", F.lit(None).cast("string"))
    else:
        rows = _place(rows, appendices, "letter")
        rows = (
            rows.withColumn("_letter", F.col("_mark.value"))
            .withColumn("_at", F.when(F.col("_letter").isNotNull(), F.col("_mark.at")).otherwise(F.col("_at")))
            .drop("_mark")
        )
    rows = rows.withColumn("_group", F.when(F.col("_letter").isNotNull(), 1).otherwise(0))
    rows = scan(rows, ["doc_id", "_group", "_at"], ["idx"], _n=running_sum(F.lit(1)))
    n = F.col("_n").cast("string")
    number = (
        F.when(F.col("_letter").isNotNull(), F.concat_ws(".", "_letter", n))
        .when(F.col("_chapter") > 0, F.concat_ws(".", F.col("_chapter").cast("string"), n))
        .otherwise(n)
    )
    return rows.select(*captions.columns, number.alias("new_number"))


def captions(
    zoned: DataFrame, kind: str, breaks: DataFrame, rules: dict, skip: str = "in_title", marks: DataFrame | None = None
) -> DataFrame:
    """Captions of one kind with the number they should carry."""
    mode = (rules.get("numbering_rules") or {}).get(f"{kind}_mode", "by_chapter")
    # Few rows, which the numbering reads several times: found once.
    found = stage(caption_rows(zoned, kind, skip, marks), "caption-rows")
    numbered = number_captions(
        found,
        breaks if mode == "by_chapter" else None,
        stage(appendix_marks(zoned, skip, marks), "appendix-marks") if kind == "listing" else None,
    )
    return numbered.withColumn("kind", F.lit(kind))


def all_captions(
    zoned: DataFrame, headings: DataFrame, rules: dict, kinds=("figure", "table"), marks: DataFrame | None = None
) -> DataFrame:
    breaks = chapter_breaks(headings)
    out = None
    for kind in kinds:
        one = captions(zoned, kind, breaks, rules, marks=marks)
        out = one if out is None else out.unionByName(one)
    return out


def caption_text() -> Column:
    """Caption line with its new number."""
    word = F.when(F.col("kind") == "figure", WORDS["figure"]).when(
        F.col("kind") == "table", WORDS["table"]
    ).otherwise(WORDS["listing"])
    return F.concat(word, F.lit(" "), F.col("new_number"), F.lit(" — "), F.col("title"))


def caption_renumbered(numbered: DataFrame) -> DataFrame:
    """Captions whose number changes."""
    return findings(
        numbered.where(F.coalesce("original_number", F.lit("")) != F.col("new_number")),
        "caption_renumbered",
        "п. 6.12",
        severity="info",
        description=F.lit("Сквозная нумерация по порядку появления в тексте (см. Было/Стало)."),
        paragraph_index=F.col("idx"),
        original_text=F.col("text"),
        fixed_text=caption_text(),
    )


def _kind(word: Column) -> Column:
    return F.when(F.lower(word).startswith("рис"), "figure").otherwise("table")


def reference_spans(rows: DataFrame) -> DataFrame:
    """Every figure or table number mentioned: doc_id, idx, span_no, num_no, kind, num, phrase."""
    lowered = F.lower("stripped")
    spans = rows.where(lowered.contains("рис") | lowered.contains("табл")).select(
        "doc_id", "idx", F.posexplode(F.regexp_extract_all("stripped", F.lit(REFERENCE), 0)).alias("span_no", "phrase")
    )
    spans = spans.select(
        "*",
        _kind(F.regexp_extract("phrase", REFERENCE, 1)).alias("kind"),
        F.regexp_extract("phrase", REFERENCE, 3).alias("nums"),
    )
    return spans.select(
        "doc_id", "idx", "span_no", "kind", "phrase",
        F.posexplode(F.regexp_extract_all("nums", F.lit(rf"(?U){_NUMBER}"), 0)).alias("num_no", "num"),
    )


def text_references(zoned: DataFrame, numbered: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """References in running text: captions and continued-table labels do not count.

    ``marks`` are taken where the paragraphs have no zones themselves. The references move, not the texts they stand in.
    """
    own = numbered.select("doc_id", "idx").distinct()
    rows = zoned.where(~F.col("is_empty") & ~F.col("stripped").rlike(_CONTINUED))
    spans = reference_spans(rows.where(~F.col("in_title")) if marks is None else rows)
    return (spans if marks is None else outside(spans, marks)).join(own, ["doc_id", "idx"], "left_anti")


def number_map(numbered: DataFrame) -> DataFrame:
    """Original number to new number; of equal originals the last caption counts."""
    return (
        numbered.where("original_number IS NOT NULL")
        .groupBy("doc_id", "kind", F.col("original_number").alias("num"))
        .agg(F.max_by("new_number", "idx").alias("mapped"))
    )


def resolve_references(references: DataFrame, numbered: DataFrame) -> DataFrame:
    """First mention of every resolved number: doc_id, kind, resolved, idx, phrase.

    Mentions are reduced to one row per number before anything is joined.
    """
    place = F.struct("idx", "span_no", "num_no", "phrase")
    firsts = references.groupBy("doc_id", "kind", "num").agg(F.min(place).alias("at"))
    valid = numbered.select("doc_id", "kind", F.col("new_number").alias("known")).distinct()
    head = F.split("num", r"\.")
    rows = (
        firsts.withColumn("head", F.get(head, 0).try_cast("long").cast("string"))
        .join(number_map(numbered), ["doc_id", "kind", "num"], "left")
        .join(
            valid.select("doc_id", "kind", F.col("known").alias("num"), F.lit(True).alias("is_valid")),
            ["doc_id", "kind", "num"],
            "left",
        )
        .join(
            valid.select("doc_id", "kind", F.col("known").alias("head"), F.lit(True).alias("head_valid")),
            ["doc_id", "kind", "head"],
            "left",
        )
    )
    whole = ~F.col("num").contains(".")
    resolved = (
        F.when(F.col("mapped").isNotNull(), F.col("mapped"))
        .when(F.col("is_valid"), F.col("num"))
        .when(whole, F.col("head"))
        .when(F.col("head_valid"), F.col("head"))
    )
    return (
        rows.withColumn("resolved", resolved)
        .where("resolved IS NOT NULL")
        .groupBy("doc_id", "kind", "resolved")
        .agg(F.min("at").alias("at"))
        .select("doc_id", "kind", "resolved", "at.idx", "at.phrase")
    )


def not_referenced(numbered: DataFrame, resolved: DataFrame) -> DataFrame:
    """Captions that no text mentions."""
    used = resolved.select("doc_id", "kind", F.col("resolved").alias("new_number"))
    rows = numbered.join(used, ["doc_id", "kind", "new_number"], "left_anti")
    figure, n = F.col("kind") == "figure", F.col("new_number")
    return findings(
        rows,
        F.when(figure, "figure_not_referenced").otherwise("table_not_referenced"),
        F.when(figure, "п. 6.12").otherwise("п. 6.13"),
        severity="info",
        description=F.when(
            figure,
            F.concat(
                F.lit("Рисунок "), n, F.lit(" пока не упомянут в тексте. Совет: добавьте короткую ссылку "
                "рядом с обсуждением иллюстрации, например «см. рисунок "), n, F.lit("»."),
            ),
        ).otherwise(
            F.concat(
                F.lit("Таблица "), n, F.lit(" пока не упомянута в тексте. Совет: добавьте короткую ссылку "
                "рядом с обсуждением данных, например «см. таблицу "), n, F.lit("»."),
            )
        ),
        paragraph_index=F.col("idx"),
        original_text=caption_text(),
    )


def dangling_references(numbered: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mentioned numbers without a caption, anchored at the first mention."""
    known = numbered.select("doc_id", "kind", F.col("new_number").alias("resolved")).distinct()
    rows = resolved.join(known, ["doc_id", "kind", "resolved"], "left_anti")
    figure, n = F.col("kind") == "figure", F.col("resolved")
    return findings(
        rows,
        F.when(figure, "figure_reference_missing").otherwise("table_reference_missing"),
        F.when(figure, "п. 6.12").otherwise("п. 6.13"),
        severity=F.when(figure, "warning").otherwise("info"),
        description=F.when(
            figure, F.concat(F.lit("В тексте ссылка на рисунок "), n, F.lit(", а сам рисунок отсутствует."))
        ).otherwise(
            F.concat(
                F.lit("В тексте есть ссылка на таблицу "), n, F.lit(", но такой таблицы не найдено. "
                "Совет: проверьте номер ссылки или добавьте соответствующую таблицу."),
            )
        ),
        paragraph_index=F.col("idx"),
        original_text=F.col("phrase"),
    )


def _reference_pieces(rows: DataFrame) -> DataFrame:
    """Text of each paragraph cut into pieces; number pieces carry their kind.

    The pieces between references come from splitting at the references, so
    piece k of the text stands before reference k.
    """
    text = F.col("text")
    cut = rows.where(text.rlike(REFERENCE)).select(
        "doc_id",
        "idx",
        F.split(text, REFERENCE).alias("outer"),
        F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)).alias("phrases"),
    )
    sep = rf"(?iU)(?<=\d)(?={_BLANK}*(?:,|и))|(?<=[,и {chr(0xA0)}])(?=\d)"

    def inner(phrase):
        word = F.regexp_extract(phrase, REFERENCE, 1)
        lead = F.concat(word, F.regexp_extract(phrase, REFERENCE, 2))
        nums = F.split(F.regexp_extract(phrase, REFERENCE, 3), sep)
        plain = F.struct(lead.alias("text"), F.lit(None).cast("string").alias("kind"))
        numbers = F.transform(
            nums,
            lambda p: F.struct(
                p.alias("text"), F.when(p.rlike(rf"(?U)^{_NUMBER}$"), _kind(word)).alias("kind")
            ),
        )
        return F.concat(F.array(plain), numbers)

    def piece(part, i):
        before = F.array(F.struct(part.alias("text"), F.lit(None).cast("string").alias("kind")))
        phrase = F.get("phrases", i)
        return F.when(phrase.isNotNull(), F.concat(before, inner(phrase))).otherwise(before)

    pieces = F.flatten(F.transform("outer", piece))
    return cut.select("doc_id", "idx", F.posexplode(pieces).alias("pos", "piece")).select(
        "doc_id", "idx", "pos", F.col("piece.text").alias("piece"), F.col("piece.kind").alias("kind")
    )


def rewrite_references(paragraphs: DataFrame, numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New text of paragraphs with references, and the links: (changes, links).

    Numbers without a caption stay as they are. ``paragraphs`` needs ``text``
    and excludes captions itself.
    """
    own = numbered.select("doc_id", "idx").distinct()
    pieces = _reference_pieces(paragraphs.join(own, ["doc_id", "idx"], "left_anti"))
    valid = numbered.select("doc_id", "kind", F.col("new_number").alias("num")).distinct()
    table = (
        number_map(numbered)
        .withColumn("rank", F.lit(0))
        .unionByName(valid.select("doc_id", "kind", "num", F.col("num").alias("mapped"), F.lit(1).alias("rank")))
        .groupBy("doc_id", "kind", "num")
        .agg(F.min_by("mapped", "rank").alias("mapped"))
    )
    numbers = (
        pieces.where("kind IS NOT NULL")
        .select("doc_id", "kind", F.col("piece").alias("num"))
        .distinct()
        .withColumn("plain", F.when(~F.col("num").contains("."), F.col("num").try_cast("long").cast("string")))
    )
    resolved = (
        numbers.join(table, ["doc_id", "kind", "num"], "left")
        .join(
            valid.select("doc_id", "kind", F.col("num").alias("plain"), F.lit(True).alias("plain_valid")),
            ["doc_id", "kind", "plain"],
            "left",
        )
        .select(
            "doc_id",
            "kind",
            F.col("num").alias("piece"),
            F.coalesce("mapped", F.when(F.col("plain_valid"), F.col("plain"))).alias("target"),
        )
    )
    # References repeat the few numbers of a manuscript, so the lookup side is small.
    marked = pieces.join(resolved, ["doc_id", "kind", "piece"], "left")
    changes = (
        marked.groupBy("doc_id", "idx")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("target", "piece").alias("piece")))).alias("p"))
        .select("doc_id", "idx", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("new_text"))
    )
    bookmark = F.when(F.col("kind") == "figure", BOOKMARKS["figure"]).otherwise(BOOKMARKS["table"])
    links = marked.where("target IS NOT NULL").select(
        "doc_id",
        "idx",
        "pos",
        F.col("target").alias("phrase"),
        F.concat(bookmark, F.translate("target", ".", "_")).alias("bookmark"),
    )
    return changes, links


def is_table_caption_line(text: Column) -> Column:
    return text.rlike(_TABLE_CAPTION_START)


def move_captions_above(elements: DataFrame) -> DataFrame:
    """Body elements in a new order: a caption typed below its table goes above it.

    ``elements(doc_id, elem_no, kind, text, cell_caption)``: kind is ``p`` or
    ``tbl``; ``cell_caption`` is a caption found in the table's first cell.
    Only tables without a caption above take one, and the nearest non-empty
    element below must be that caption, so no table takes its neighbour's.
    Returns the rows with ``new_pos`` (sortable) and ``moved``.
    """
    stripped = tx.strip_blank(F.coalesce("text", F.lit("")))
    solid = (F.col("kind") == "tbl") | (stripped != "")
    rows = elements.withColumn("_cap", (F.col("kind") == "p") & is_table_caption_line(stripped))
    seen = F.when(solid, F.struct("elem_no", "kind", "_cap"))
    rows = scan(rows, DOC, ["elem_no"], _above=prev(seen), _below=following(seen))
    captioned = tx.is_true(F.col("_above._cap"))
    takes = (F.col("kind") == "tbl") & ~captioned & tx.is_true(F.col("_below._cap"))
    rows = rows.withColumn("_takes", takes).withColumn(
        "_from_cell", (F.col("kind") == "tbl") & ~captioned & ~takes & F.col("cell_caption").isNotNull()
    )
    rows = scan(rows, DOC, ["elem_no"], _owner=prev(F.when(solid, F.struct("elem_no", "_takes"))))
    moved = F.col("_cap") & tx.is_true(F.col("_owner._takes"))
    base = rows.select(
        "doc_id",
        "elem_no",
        "kind",
        "text",
        F.when(moved, F.col("_owner.elem_no") * 2 - 1).otherwise(F.col("elem_no") * 2).cast("long").alias("new_pos"),
        moved.alias("moved"),
        "_from_cell",
        "cell_caption",
    )
    lifted = base.where("_from_cell").select(
        "doc_id",
        "elem_no",
        F.lit("p").alias("kind"),
        F.col("cell_caption").alias("text"),
        (F.col("new_pos") - 1).alias("new_pos"),
        F.lit(True).alias("moved"),
    )
    return base.drop("_from_cell", "cell_caption").unionByName(lifted)


def caption_table_pairs(elements: DataFrame, numbered: DataFrame) -> DataFrame:
    """Tables with their caption, the last non-empty paragraph before them.

    ``elements(doc_id, elem_no, kind, text, idx, tbl_no)`` is the body order.
    """
    own = numbered.select(
        "doc_id", "idx", F.struct("new_number", "title", F.col("idx").alias("at")).alias("_cap")
    )
    rows = elements.join(own, ["doc_id", "idx"], "left")
    solid = (F.col("kind") == "tbl") | (tx.strip_blank(F.coalesce("text", F.lit(""))) != "")
    rows = scan(
        rows.select("doc_id", "elem_no", "kind", "tbl_no", "_cap", solid.alias("_solid")),
        DOC,
        ["elem_no"],
        _above=prev(F.when(F.col("_solid"), F.struct("_cap"))),
    )
    return rows.where("kind = 'tbl' AND _above._cap IS NOT NULL").select(
        "doc_id",
        "tbl_no",
        F.col("_above._cap.at").alias("caption_idx"),
        F.col("_above._cap.new_number").alias("number"),
        F.col("_above._cap.title").alias("title"),
    )
