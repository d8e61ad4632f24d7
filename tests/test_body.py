"""Element order: captions above tables, blanks after blocks, and the whole revision of a manuscript with tables."""

from pyspark.sql import functions as F

from galley.operators import body, captions, structure
from galley.plans import reports
from galley.rules import default_rules
from galley.schema import conform

RULES = default_rules()
CELLS = "doc_id long, row_no int, col_no int, elem_no int, text string"


def paragraphs(spark, doc, layout):
    """Paragraphs of a body in which None stands for a table."""
    rows = [(doc, e, t) for e, t in enumerate(layout) if t is not None]
    rows = [(d, i, e, t, e + 1 < len(layout) and layout[e + 1] is None) for i, (d, e, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, idx int, elem_no int, text string, table_follows boolean")


def texts(df):
    return [(r.idx, r.elem_no, r.text, r.table_follows, r.next_is_table) for r in df.orderBy("idx").collect()]


def test_captions_move_and_leave_cells(spark, blocks):
    layout = [None, "", "Таблица 1 — Итоги", "Текст", None, "Таблица 2 — Ниже", None, "Конец", None]
    given = conform(paragraphs(spark, 7, layout)).withColumn("given_idx", F.col("idx"))
    cells = spark.createDataFrame([(7, 0, 0, 8, "\n Таблица 3 — В ячейке\nx"), (7, 0, 0, 6, "Имя"), (7, 1, 0, 0, "Таблица 9 — Нет")], CELLS)
    placed, tables = body.with_captions_above(given, cells)
    assert texts(placed) == [
        (0, 0, "Таблица 1 — Итоги", True, True),
        (1, 2, "", False, False),
        (2, 3, "Текст", False, False),
        (3, 4, "Таблица 2 — Ниже", True, True),
        (4, 7, "Конец", False, False),
        (5, 8, "Таблица 3 — В ячейке", True, True),
    ]
    assert sorted(r.elem_no for r in tables.collect()) == [1, 5, 6, 9]
    assert [r.given_idx for r in placed.orderBy("idx").collect()] == [1, 0, 2, 3, 4, None]


def test_blanks_after_blocks(spark, blocks):
    layout = ["Рисунок 1 — Титул", "Рисунок 2 — Схема", "Текст", None, "", "Дальше", None, None]
    rows = conform(paragraphs(spark, 7, layout)).withColumn("in_title", F.col("idx") == 0).withColumn("is_empty", F.col("text") == "")
    tables = spark.createDataFrame([(7, 3), (7, 6), (7, 7)], "doc_id long, elem_no int")
    assert [t[:3] for t in texts(body.with_blanks_after(rows, tables))] == [
        (0, 0, "Рисунок 1 — Титул"), (1, 1, "Рисунок 2 — Схема"), (2, 2, ""), (3, 3, "Текст"),
        (4, 5, ""), (5, 6, "Дальше"), (6, 8, ""), (7, 10, ""),
    ]


def test_no_tables_and_no_rows(spark):
    rows = conform(paragraphs(spark, 7, ["а", "б"]))
    placed, tables = body.with_captions_above(rows)
    assert [t[:3] for t in texts(placed)] == [(0, 0, "а"), (1, 1, "б")] and tables.isEmpty()
    assert body.with_captions_above(rows.limit(0))[0].isEmpty()


def test_revise_orders_the_body(spark):
    layout = [
        "ВВЕДЕНИЕ", "Текст введения о работе, как показано в таблице 5.", "", "1 Методы исследования", "Строка текста перед таблицей данных.",
        None, "Таблица 5 — Итоги", "Ещё одна строка обычного текста.", "Рисунок 4 — Схема", "2 Результаты работы", "Последняя строка текста.",
        "ЗАКЛЮЧЕНИЕ", "Вывод.",
    ]
    given = paragraphs(spark, 1, layout).withColumn("style_name", F.when(F.col("text").rlike(r"^(\d |[А-Я]{4})"), "Heading 1").otherwise("Normal"))
    revised = reports.revise(reports.Manuscripts(conform(given)), RULES).paragraphs.orderBy("idx").collect()
    shown = [r.text for r in revised]
    caption = next(i for i, t in enumerate(shown) if t.startswith("Таблица"))
    assert shown[caption] == "Таблица 1.1 — Итоги" and shown[caption - 1].startswith("Строка текста")
    assert revised[caption].table_follows and shown[caption + 1] == "" and revised[caption + 1].old_idx is None
    assert revised[caption + 1].elem_no == revised[caption].elem_no + 2
    figure = shown.index("Рисунок 1.1 — Схема")
    assert shown[figure + 1] == "" and shown[figure + 2] == "2 Результаты работы"
    breaks = {r.text for r in revised if r.has_page_break_before}
    assert {"1 Методы исследования", "2 Результаты работы"} <= breaks and "Вывод." not in breaks
    assert [r.idx for r in revised] == list(range(len(revised)))
    assert [r.old_idx for r in revised if r.old_idx is not None] == sorted(set(range(12)) - {2})


def test_captions_are_numbered_without_reading_the_texts_again(spark):
    layout = ["1 Методы", "Рисунок 4 — Схема", "Текст.", "ПРИЛОЖЕНИЕ А", "Листинг 3 — Код", "def f(): return 1"]
    rows = reports.zoned(conform(paragraphs(spark, 1, layout))).withColumn("in_title", F.lit(False))
    heads = spark.createDataFrame([(1, 0, 1, "1 Методы", "1")], "doc_id long, idx int, level int, text string, number string")
    for kind in ("figure", "listing"):
        numbered = captions.captions(rows, kind, captions.chapter_segments(heads.selectExpr("doc_id", "idx", "1L AS chapter")), RULES)
        read = {f.rpartition("/")[0].rpartition("/")[2] for f in numbered.inputFiles()}
        assert not any(name.startswith("features") for name in read)
        assert numbered.count() == 1


def test_manuscripts_that_may_hold_malformed_headings(spark):
    asked = ["Введение ........ 3", "Текст."], ["Введение", "Текст 3"], ["Заключение\t12"]
    given = paragraphs(spark, 1, asked[0]).unionByName(paragraphs(spark, 2, asked[1])).unionByName(paragraphs(spark, 3, asked[2]))
    assert sorted(r.doc_id for r in structure.may_hold_malformed(conform(given), RULES).collect()) == [1, 3]
