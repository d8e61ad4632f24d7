import pytest
from pyspark.sql import functions as F

from galley.functions import text as tx
from galley.operators import citations, revision


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("text, expected", [
    ("Глава 2. Анализ", ("chapter_word", "2", 1, "Анализ")),
    ("ГЛАВА IV Итоги", ("chapter_word", "4", 1, "Итоги")),
    ("Раздел 2.1 — Метод", ("chapter_word", "2.1", 2, "Метод")),
    ("Глава 1", ("chapter_word", "1", 1, "")),
    ("1.2.3 Название", ("number", "1.2.3", 3, "Название")),
    ("1.2.Название", ("number", "1.2", 2, "Название")),
    ("01) Вводная", ("number", "1", 1, "Вводная")),
    ("3D-модель", None),
    ("5", None),
    ("Глава без номера", None),
])
def test_heading_prefix(spark, text, expected):
    p = one(spark, tx.heading_prefix, text)
    assert (None if p is None else (p.kind, p.number, p.level, p.title)) == expected


@pytest.mark.parametrize("text, value", [("XIV", 14), ("mcmxc", 1990), ("iiii", None), ("", None), ("mmmcmxcix", 3999)])
def test_roman(spark, text, value):
    assert one(spark, tx.roman_to_int, text) == value


@pytest.mark.parametrize("text, expected", [
    ("[1][2] [3]", "[1], [2], [3]"), ("a [1] b [2]", "a [1] b [2]"), ("[1-3][4,5]", "[1-3], [4,5]"),
])
def test_fix_separators(spark, text, expected):
    assert one(spark, citations.fix_separators, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("x [1,2, 3] y", "x [1], [2], [3] y"), ("[1-3] [4]", "[1-3] [4]"), ("[1,2][3,4]", "[1], [2][3], [4]"),
])
def test_fix_combined(spark, text, expected):
    assert one(spark, citations.fix_combined, text) == expected


@pytest.mark.parametrize("text, expected", [
    ("ГЛАВА 1. ТЕОРИЯ И МЕТОД", "1 Теория и метод"),
    ("введение", "ВВЕДЕНИЕ"),
    ("ПРИЛОЖЕНИЕ А", "Приложение А"),
    ("2.1.  постановка   задачи.", "2.1 Постановка задачи"),
    ("ТЕОРИЯ И ТЕХНОЛОГИИ", "Теория и технологии"),
])
def test_normalise_heading(spark, text, expected):
    rows = spark.createDataFrame([(text,)], "text string")
    assert revision.normalise_heading_text(rows).first().text == expected


def test_unicode_edges_and_case(spark):
    assert one(spark, tx.strip_blank, chr(0xA0) + " a b " + chr(0x200B)) == "a b"
    assert one(spark, lambda c: tx.is_caption(c), "РИСУНОК 2 – Схема") is True
    assert one(spark, tx.word_count, "один " + chr(0xA0) + " два\tтри") == 3


@pytest.mark.parametrize("text, expected", [
    ("ßen und Länge", "ẞen und Länge"), ("1 ßtraße", "1 ẞtraße"), ("ﬁgur", "ﬁgur"), ("ᾳδω", "ᾼδω"), ("ΟΔΟΣ ΑΒΣ", "Οδοσ αβσ"), ("İST İZ", "İst iz"), ("введение ß", "ВВЕДЕНИЕ ẞ"),
])
def test_case_letter_by_letter(spark, text, expected):
    rows = spark.createDataFrame([(text,)], "text string")
    assert revision.normalise_heading_text(rows).first().text == expected
