"""Manuscripts, tables and workflow rows derived from the given test tables.

The given documents are plain prose; these projections dress every line of
them up as a manuscript (headings, citations, captions, formulas, sources,
appendices, layout) by arithmetic on the keys, so results grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.session import configure

FRONT_ROWS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "txt"))


def _front() -> str:
    """Title page and contents of every fifth manuscript."""
    return """
    CASE WHEN doc_id % 5 = 0 THEN array(
      'Государственный университет', 'Факультет наук', 'Кафедра методов',
      CASE WHEN doc_id % 10 = 0 THEN 'Выпускная квалификационная работа' ELSE 'Отчёт по теме исследования' END,
      '', 'Город 2024',
      CASE WHEN doc_id % 3 = 0 THEN 'Оглавление' ELSE 'СОДЕРЖАНИЕ' END,
      CASE doc_id % 15 WHEN 0 THEN 'Введение ........ 3' WHEN 5 THEN 'Введение' ELSE 'Первая глава о методах' END,
      CASE doc_id % 15 WHEN 0 THEN concat('1 Раздел', chr(9), '5') WHEN 5 THEN 'ЗАКЛЮЧЕНИЕ' ELSE 'Вторая глава о данных' END,
      CASE doc_id % 15 WHEN 0 THEN 'Заключение — 9' WHEN 5 THEN 'Список использованных источников' ELSE 'Третья часть' END,
      CASE doc_id % 15 WHEN 0 THEN 'Список литературы    12' WHEN 5 THEN '' ELSE 'Термины и определения' END,
      '') ELSE array() END"""


# SQL text of the projections, in the subset that other SQL engines read alike.
BODY = """
    CASE WHEN (doc_id * 3 + ln) % 31 = 0 THEN '' ELSE
    CASE ln % 10
      WHEN 0 THEN concat(CAST(1 + CAST(floor(ln / 10) AS INT) + CASE WHEN doc_id % 7 = 0 AND ln >= 20 THEN 1 ELSE 0 END AS STRING), ' ', substr(txt, 1, 40))
      WHEN 1 THEN concat(txt, ' [', CAST(1 + (doc_id + ln) % 8 AS STRING), ']', CASE WHEN doc_id % 18 = 0 THEN ' (приложение В)' ELSE '' END)
      WHEN 2 THEN concat(txt, ' [', CAST(1 + doc_id % 5 AS STRING), '][', CAST(2 + doc_id % 5 AS STRING), '] [1,', CAST(2 + ln % 3 AS STRING), ']', CASE WHEN doc_id % 18 = 0 THEN ' (приложение А)' ELSE '' END)
      WHEN 3 THEN concat('Рисунок ', CAST(1 + (doc_id + ln) % 9 AS STRING), CASE WHEN doc_id % 4 = 3 THEN ' ' ELSE ' — ' END, substr(txt, 1, 30))
      WHEN 4 THEN concat(txt, ' см. рисунок ', CAST(1 + ln % 4 AS STRING), ' и таблица 1, 2')
      WHEN 5 THEN concat('y = ax + ', CAST(ln AS STRING), ' (', CAST(1 + CAST(floor(ln / 10) AS INT) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS STRING), ')')
      WHEN 6 THEN CASE WHEN doc_id % 12 = 1 AND ln = 6 THEN '1.1 Методы. Итоги части:'
                       WHEN doc_id % 6 = 1 AND (doc_id + ln + 3) % 4 = 0 THEN concat('1.', CAST(1 + CAST(floor(ln / 10) AS INT) AS STRING), ' Методы. Итоги части')
                       WHEN doc_id % 6 = 1 THEN concat('1.', CAST(1 + CAST(floor(ln / 10) AS INT) AS STRING), ' Раздел метода')
                       WHEN doc_id % 3 = 0 THEN concat('тогда ', txt) ELSE concat('где ', txt) END
      WHEN 7 THEN CASE WHEN doc_id % 2 = 1 THEN concat('Листинг ', CAST(1 + ln % 5 AS STRING), ' — ', substr(txt, 1, 20)) ELSE concat(txt, ' [2-', CAST(3 + ln % 40 AS STRING), ']') END
      WHEN 8 THEN CASE WHEN doc_id % 2 = 1 THEN 'def f(x):' ELSE concat(txt, ' (приложение А)') END
      ELSE CASE WHEN doc_id % 8 = 5 THEN concat('Глава ', CAST(1 + CAST(floor(ln / 10) AS INT) AS STRING), CASE WHEN ln % 20 = 9 THEN '' ELSE concat('. ', substr(txt, 1, 12)) END)
                ELSE concat('Таблица ', CAST(1 + ln % 7 AS STRING), ' — ', substr(txt, 1, 25)) END END END"""


# What BODY leaves out of a line: it follows as a paragraph of its own, so no text is lost.
REST = """
    CASE WHEN (doc_id * 3 + ln) % 31 = 0 THEN txt ELSE
    CASE ln % 10
      WHEN 0 THEN substr(txt, 41)
      WHEN 3 THEN substr(txt, 31)
      WHEN 5 THEN txt
      WHEN 6 THEN CASE WHEN doc_id % 6 = 1 THEN txt ELSE '' END
      WHEN 7 THEN CASE WHEN doc_id % 2 = 1 THEN substr(txt, 21) ELSE '' END
      WHEN 8 THEN CASE WHEN doc_id % 2 = 1 THEN txt ELSE '' END
      WHEN 9 THEN CASE WHEN doc_id % 8 = 5 THEN CASE WHEN ln % 20 = 9 THEN txt ELSE substr(txt, 13) END ELSE substr(txt, 26) END
      ELSE '' END END"""

# Lines after the introduction of some manuscripts, by doc_id % 21; their position marks their layout:
# bold short lines, and a chapter of which two headings carry no style.
LISTED_POS, CHAPTER_POS, SECTION_POS, PLAIN_POS = -105, -111, -112, -113
EXTRA = {
    8: (("Первый пункт перечня", LISTED_POS), ("Второй пункт перечня", LISTED_POS), ("Третий пункт перечня", LISTED_POS)),
    9: (("4 Анализ данных", CHAPTER_POS), ("4.1 Методы. Итоги части", PLAIN_POS), ("4.2 Раздел метода", SECTION_POS),
        ("4.3 Методы. Итоги", PLAIN_POS), ("4.4 Раздел выводов", SECTION_POS)),
}


def _tail() -> str:
    return """concat(
      CASE WHEN doc_id % 19 = 7 THEN array('Термины и определения') ELSE array() END,
      CASE WHEN doc_id % 9 <> 0 AND doc_id % 19 <> 6 THEN array('ЗАКЛЮЧЕНИЕ') ELSE array() END,
      CASE WHEN doc_id % 13 <> 0 THEN concat(
        array(CASE doc_id % 8 WHEN 0 THEN 'Список литературы' WHEN 1 THEN 'Список литературы ........ 41' ELSE 'СПИСОК ИСПОЛЬЗОВАННЫХ ИСТОЧНИКОВ' END),
        transform(sequence(1, 6), k -> CASE
          WHEN doc_id % 17 = 0 AND k = 2 THEN '18-32. Автор Б. Б. Сборник трудов'
          WHEN doc_id % 10 = 4 AND k >= 4 THEN concat('Автор В. В. Статья номер ', CAST(k AS STRING), ', 2019. 5 с.')
          ELSE concat(CAST(k + CASE WHEN doc_id % 11 = 0 AND k > 3 THEN 1 ELSE 0 END AS STRING), '. Автор А. А. Работа о методах',
            CASE WHEN (doc_id + k) % 6 = 0 THEN '' ELSE concat(', ', CAST(2010 + k AS STRING), '. 10 с.') END) END)) ELSE array() END,
      CASE WHEN doc_id % 19 = 6 THEN array('ЗАКЛЮЧЕНИЕ') ELSE array() END,
      CASE WHEN doc_id % 2 = 0 THEN concat(array('ПРИЛОЖЕНИЕ А'),
        CASE WHEN doc_id % 14 = 6 THEN array('схема данных') ELSE array() END,
        array(CASE WHEN doc_id % 6 = 0 THEN 'ПРИЛОЖЕНИЕ В' WHEN doc_id % 14 = 2 THEN 'ПРИЛОЖЕНИЕ З' ELSE 'ПРИЛОЖЕНИЕ Б' END))
        ELSE array() END)"""


LAYOUT = {
    "alignment": """CASE WHEN pos BETWEEN -12 AND -7 THEN 'center' ELSE CASE (doc_id + idx) % 5 WHEN 0 THEN 'center'
            WHEN 1 THEN 'left' ELSE 'justify' END END""",
    "first_line_indent_cm": "CASE WHEN (doc_id + idx) % 19 = 0 THEN CAST(0.0 AS DOUBLE) WHEN (doc_id + idx) % 43 = 0 THEN CAST(-0.5 AS DOUBLE) ELSE CAST(1.25 AS DOUBLE) END",
    "max_font_size_pt": "CASE WHEN (doc_id + idx) % 17 = 0 THEN CAST(16.0 AS DOUBLE) WHEN (doc_id + idx) % 13 = 0 THEN CAST(12.0 AS DOUBLE) ELSE CAST(14.0 AS DOUBLE) END",
    "modal_font_size_pt": "CASE WHEN (doc_id + idx) % 17 = 0 THEN CAST(16.0 AS DOUBLE) WHEN (doc_id + idx) % 13 = 0 THEN CAST(12.0 AS DOUBLE) ELSE CAST(14.0 AS DOUBLE) END",
    "font_family": "CASE WHEN (doc_id + idx) % 23 = 0 THEN 'Arial' ELSE 'Times New Roman' END",
    "bold_ratio": f"CASE WHEN pos = {LISTED_POS} THEN CAST(0.9 AS DOUBLE) ELSE CAST((doc_id * 7 + idx * 3) % 11 AS DOUBLE) / 10 END",
    "in_table": f"pos <> {LISTED_POS} AND (doc_id * 5 + idx) % 37 = 0",
    "style_name": f"""CASE WHEN pos = {CHAPTER_POS} THEN 'Heading 1' WHEN pos = {SECTION_POS} THEN 'Heading 2'
            WHEN pos % 10 = 1 AND (doc_id % 2 = 0 OR doc_id % 6 = 1) THEN 'Heading 1'
            WHEN pos % 10 = 7 AND doc_id % 6 = 1 AND (doc_id + pos + 2) % 4 <> 0 AND NOT (pos = 7 AND doc_id % 12 = 1) THEN 'Heading 2'
            WHEN pos % 10 = 9 AND doc_id % 4 = 2 THEN 'List Paragraph' ELSE 'Normal' END""",
    "has_tab": "instr(text, chr(9)) > 0 OR (doc_id + idx) % 4 = 0",
    "numpr_ilvl": "CASE WHEN pos % 10 IN (8, 9) AND doc_id % 4 = 0 THEN CAST(idx % 3 AS INT) END",
    "numpr_num_id": "CASE WHEN pos % 10 IN (8, 9) AND doc_id % 4 = 0 THEN CAST(1 + doc_id % 3 AS INT) END",
    "outline_level": "CASE WHEN pos % 10 = 1 AND doc_id % 3 = 0 THEN 0 END",
    "has_page_break_before": "(doc_id + idx) % 29 = 0",
    "has_image": "pos % 10 = 3 AND doc_id % 3 = 0",
    "table_follows": "pos % 10 = 0 AND pos > 0",
    "next_is_table": "pos % 10 = 0 AND pos > 0",
    "mono": "pos % 10 = 9 AND doc_id % 4 = 1",
    "space_after_pt": "CASE WHEN doc_id % 10 = 3 THEN CAST(8.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END",
    "line_spacing": "CASE WHEN doc_id % 10 = 7 THEN CAST(1.0 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END",
    "elem_no": "idx + tables_before",
}


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manuscript paragraphs with text and layout, from one pass over the documents.

    ``pos`` is the place of a dressed line (0: introduction and what is left of
    lines, negative: front matter), ``tables_before`` the tables so far.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    extra = "CASE doc_id % 21 " + " ".join(
        f"WHEN {k} THEN array({', '.join(f'struct({t!r} AS text, {p} AS pos, 0 AS tables_before)' for t, p in lines)})" for k, lines in EXTRA.items()
    ) + " ELSE array() END"
    made = F.expr(
        f"""concat(
        transform({_front()}, (t, i) -> struct(t AS text, i - {FRONT_ROWS} AS pos, 0 AS tables_before)),
        array(struct(CASE WHEN doc_id % 4 = 0 THEN 'Предисловие' ELSE 'ВВЕДЕНИЕ' END AS text, 0 AS pos, 0 AS tables_before)),
        {extra},
        filter(flatten(transform(lines, (txt, ln) -> array(
          struct({BODY} AS text, ln + 1 AS pos, CAST(floor(ln / 10) AS INT) AS tables_before),
          struct({REST} AS text, 0 AS pos, CAST(floor((ln + 1) / 10) AS INT) AS tables_before)))), p -> p.pos > 0 OR p.text <> ''),
        transform({_tail()}, (t, i) -> struct(t AS text, size(lines) + 1 + i AS pos, CAST(floor((size(lines) + i) / 10) AS INT) AS tables_before)))"""
    )
    rows = docs.select("doc_id", F.posexplode(made).alias("idx", "p")).select("doc_id", "idx", "p.*")
    fonts = "CASE WHEN mono THEN array('courier new') ELSE array('times new roman') END"
    rows = rows.select("doc_id", "idx", "text", "pos", *[F.expr(v).alias(k) for k, v in LAYOUT.items()])
    return rows.withColumn("run_fonts", F.expr(fonts)).drop("mono")


def hidden_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts inside content controls: some manuscripts keep their contents title there."""
    return table(spark, sf_dir, "documents").where("doc_id % 4 = 3").select("doc_id", F.lit("содержание").alias("norm"))


def body_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and tables in body order: doc_id, elem_no, kind, text, idx, tbl_no, cell_caption."""
    rows = paragraphs(spark, sf_dir)
    none = F.lit(None)
    table_no = F.expr("CAST(floor((pos - 1) / 10) AS INT)")
    paras = rows.select(
        "doc_id", F.col("elem_no").cast("long").alias("elem_no"), F.lit("p").alias("kind"), "text",
        F.col("idx").cast("int").alias("idx"), none.cast("int").alias("tbl_no"), none.cast("string").alias("cell_caption"),
        F.lit(False).alias("has_section_break"),
    )
    tables = rows.where("table_follows").select(
        "doc_id", (F.col("elem_no") + 1).cast("long").alias("elem_no"), F.lit("tbl").alias("kind"), none.cast("string").alias("text"),
        none.cast("int").alias("idx"), table_no.alias("tbl_no"),
        F.expr("CASE WHEN doc_id % 6 = 4 THEN 'Таблица 1 — Итоги' END").alias("cell_caption"),
        F.lit(False).alias("has_section_break"),
    )
    return paras.unionByName(tables)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of twenty characters of every line of the documents, to its end, with emphasis and sizes."""
    lines = base_lines(spark, sf_dir).withColumnsRenamed({"ln": "idx"})
    last = F.expr("CAST(floor((greatest(length(txt), 1) - 1) / 20) AS INT)")
    run = F.explode(F.sequence(F.lit(0), last)).alias("run_no")
    rows = lines.select("doc_id", "idx", "txt", run)
    return rows.select(
        "doc_id",
        "idx",
        "run_no",
        F.expr("substr(txt, run_no * 20 + 1, 20)").alias("text"),
        F.expr("(doc_id + idx + run_no) % 3 = 0").alias("bold"),
        F.expr("(doc_id + run_no) % 4 = 0").alias("italic"),
        F.expr("CASE WHEN (doc_id + idx * 2 + run_no) % 7 = 0 THEN NULL WHEN (doc_id + run_no) % 5 = 0 THEN 12.04D ELSE 14.0D END").alias("size_pt"),
    )


_ROW_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one table per part: doc_id, tbl_no, row_no, cells, runs, page.

    Rows are numbered with a block scan over the order key, so a part that
    holds a large share of all lines does not end up in one task.
    """
    from galley.scan import running_sum, scan

    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", *_ROW_ORDER)
    numbered = scan(lines, ["l_partkey"], _ROW_ORDER, ranged=True, row_no=running_sum(F.lit(1), inclusive=False))
    rows = numbered.select(
        F.col("l_partkey").alias("doc_id"),
        F.lit(0).alias("tbl_no"),
        F.col("row_no").cast("int").alias("row_no"),
        F.col("l_quantity").cast("int").cast("string").alias("cell_1"),
        F.concat("l_returnflag", "l_linestatus").alias("cell_2"),
        F.lit(2).alias("total_runs"),
        F.expr("CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 1 END").alias("bold_runs"),
    )
    return rows.withColumn(
        "page",
        F.expr("CASE WHEN row_no % 5 = 4 OR (doc_id % 10 = 9 AND row_no < 2) THEN NULL ELSE CAST(9 + floor(row_no / 12) AS INT) END"),
    )


def table_cells(rows: DataFrame) -> DataFrame:
    """The two cells of every table row as rows of their own; some tables are mere forms."""
    form = F.expr("doc_id % 7 = 3")
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("col_no"), F.when(form, "____").otherwise(F.col(f"cell_{i + 1}")).alias("text"))
            for i in range(2)
        ]
    )
    return rows.select("doc_id", "tbl_no", "row_no", F.inline(cells))


def table_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captioned tables: every part but each eleventh."""
    parts = table(spark, sf_dir, "part").where("p_partkey % 11 <> 0")
    return parts.select(
        F.col("p_partkey").cast("long").alias("doc_id"),
        F.lit(0).alias("tbl_no"),
        F.lit(0).alias("caption_idx"),
        F.expr("CAST(1 + p_partkey % 9 AS STRING)").alias("number"),
        F.col("p_name").alias("title"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("timestamp").alias("uploaded_at"),
        F.expr("concat('thesis_', CAST(o_orderkey AS STRING), '.docx')").alias("original_filename"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'processing' ELSE 'error' END").alias("status"),
        F.expr(
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'pending_review' WHEN '2-HIGH' THEN 'approved' "
            "WHEN '3-MEDIUM' THEN 'rejected' END"
        ).alias("approval_status"),
        F.expr("CAST(o_orderdate AS TIMESTAMP) + INTERVAL '90' DAY").alias("expires_at"),
        F.expr("CAST(1 + o_orderkey % 3 AS INT)").alias("version_id"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    students = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("full_name"),
        F.expr("concat('u', CAST(c_custkey AS STRING), '@mail.test')").alias("email"),
        F.lit("student").alias("role"),
        F.expr("CASE WHEN c_custkey % 12 = 11 THEN NULL ELSE 1000000 + c_custkey % 10 END").cast("long").alias("supervisor_id"),
    )
    staff = table(spark, sf_dir, "supplier").select(
        F.expr("1000000 + s_suppkey").cast("long").alias("user_id"),
        F.col("s_name").alias("full_name"),
        F.expr("concat('s', CAST(s_suppkey AS STRING), '@mail.test')").alias("email"),
        F.expr("CASE WHEN s_suppkey % 10 = 9 THEN 'dean' ELSE 'supervisor' END").alias("role"),
        F.lit(None).cast("long").alias("supervisor_id"),
    )
    return students.unionByName(staff)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored findings, one per order line; the id is a digest, so no global sort is needed."""
    lines = table(spark, sf_dir, "lineitem")
    cents = "CAST(round(l_extendedprice * 100) AS BIGINT)"
    key = (
        "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
        f"{cents}, CAST(l_quantity AS INT), date_format(l_shipdate, 'yyyy-MM-dd'))"
    )
    return lines.select(
        F.expr(f"md5({key})").alias("finding_id"),
        F.col("l_orderkey").alias("doc_id"),
        F.expr(
            "CASE l_partkey % 6 WHEN 0 THEN 'heading_number_conflict' WHEN 1 THEN 'heading_confirm' "
            "WHEN 2 THEN 'citation_without_source' WHEN 3 THEN 'caption_renumbered' "
            "WHEN 4 THEN 'volume_below_minimum' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'forbidden_heading' ELSE 'unknown_type' END END"
        ).alias("type"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'info' END").alias("severity"),
        F.expr(
            "CASE WHEN l_linestatus = 'O' THEN 'manual_required' WHEN l_suppkey % 3 = 0 THEN 'accepted' "
            "WHEN l_suppkey % 3 = 1 AND l_partkey % 5 = 0 THEN 'rejected' ELSE 'auto_fixed' END"
        ).alias("status"),
        F.expr("CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 200 AS INT) END").alias("paragraph_index"),
        F.expr("concat('section ', CAST(l_partkey % 50 AS STRING))").alias("section_title"),
        F.expr("CASE WHEN l_partkey % 4 = 0 THEN concat(CAST(1 + l_partkey % 3 AS STRING), '.', CAST(l_linenumber AS STRING)) ELSE CAST(1 + l_partkey % 3 AS STRING) END").alias("original_text"),
        F.expr("CASE WHEN l_partkey % 3 = 0 THEN concat('fixed ', CAST(l_linenumber AS STRING)) END").alias("fixed_text"),
        F.expr("CASE WHEN l_linenumber > 1 AND l_suppkey % 2 = 0 THEN CAST(l_partkey % 200 - l_linenumber AS INT) END").alias("caused_by_index"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.expr("1 + conv_id").alias("doc_id"),
        "turn",
        F.col("role").alias("author_role"),
        F.col("text").alias("body"),
        F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(turn AS INT), 0, 0)").alias("created_at"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("doc_id"),
        F.col("ts").cast("timestamp").alias("decided_at"),
        F.expr(
            "CASE event_type WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'approve' "
            "WHEN 'error' THEN 'reject' ELSE 'comment' END"
        ).alias("action"),
        F.expr("CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('note ', CAST(event_id AS STRING)) END").alias("comment"),
    )


def heading_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold and predicted heading level per paragraph (null: no heading)."""
    rows = paragraphs(spark, sf_dir).select("doc_id", "idx")
    return rows.select(
        "doc_id",
        "idx",
        F.expr("CASE WHEN idx % 10 = 1 THEN CAST(1 + doc_id % 3 AS INT) END").alias("gold_level"),
        F.expr(
            "CASE WHEN idx % 10 = 1 AND (doc_id + idx) % 6 <> 0 THEN "
            "CAST(1 + (doc_id + CASE WHEN idx % 20 = 1 THEN 0 ELSE doc_id % 2 END) % 3 AS INT) "
            "WHEN (doc_id * 3 + idx) % 41 = 0 THEN 2 END"
        ).alias("pred_level"),
    )


def timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"),
        F.expr("event_id % 3").alias("run_no"),
        F.col("event_type").alias("step"),
        F.col("value").alias("duration_ms"),
        F.col("event_id").alias("seq"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered pages of each manuscript: twelve lines a page, then a footer number."""
    lines = paragraphs(spark, sf_dir).select(
        "doc_id", F.expr("CAST(floor(idx / 12) AS INT) + 1").alias("page_no"), F.expr("idx % 12").alias("line_no"), "text"
    )
    # A page never has more than its twelve lines, so one page is one bounded row.
    return lines.groupBy("doc_id", "page_no").agg(
        F.concat(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n"),
            F.lit("\n"),
            (F.col("page_no") + F.expr("CAST(doc_id % 3 AS INT)")).cast("string"),
        ).alias("text")
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule versions, one per nation."""
    return table(spark, sf_dir, "nation").select(
        F.expr("CAST(n_nationkey AS INT)").alias("version_id"),
        F.col("n_name").alias("name"),
        F.expr("n_nationkey = 1").alias("is_active"),
        F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(n_nationkey AS INT), 0, 0, 0)").alias("created_at"),
    )
