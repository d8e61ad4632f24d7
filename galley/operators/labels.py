"""Names, categories and orders of finding types, as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNKNOWN_LABEL, UNKNOWN_CATEGORY = "Замечание оформления", "Прочее"

# Name shown for every finding type.
TYPE_LABELS = {
    "missing_structural_section": "Отсутствует обязательный раздел",
    "structural_order_violation": "Нарушен порядок разделов",
    "appendix_letter_invalid": "Недопустимая буква приложения",
    "appendix_letter_gap": "Пропуск в нумерации приложений",
    "appendix_not_referenced": "Приложение не упомянуто в тексте",
    "appendix_order_violation": "Порядок приложений нарушен",
    "citation_sequence_issue": "Нарушен порядок ссылок",
    "citation_without_source": "Ссылка без источника в списке",
    "citation_separator_missing": "Нет разделителя между ссылками",
    "citation_combined": "Несколько источников в одной скобке — разбито",
    "citation_range_suspicious": "Подозрительный диапазон ссылок",
    "source_not_cited": "Источник не упомянут в тексте",
    "bibliography_missing": "Список источников отсутствует",
    "bibliography_numbering_gap": "Нарушена нумерация источников",
    "bibliography_entry_incomplete": "Неполная запись источника",
    "bibliography_entry_malformed": "Некорректный номер записи источника",
    "bibliography_entries_unrecognised": "Записи источников не распознаны",
    "forbidden_heading": "Недопустимый заголовок",
    "heading_rename": "Заголовок раздела приведён к канону",
    "heading_number_conflict": "Конфликт нумерации заголовка",
    "heading_confirm": "Возможный заголовок — подтвердите",
    "possible_missed_heading": "Возможный пропущенный заголовок",
    "heading_recovered": "Восстановлен пропущенный заголовок",
    "figures_renumbered": "Нумерация рисунков исправлена",
    "tables_renumbered": "Нумерация таблиц исправлена",
    "caption_renumbered": "Нумерация подписи изменена",
    "figure_not_referenced": "Рисунок без ссылки в тексте",
    "figure_reference_missing": "Ссылка на несуществующий рисунок",
    "table_not_referenced": "Таблица без ссылки в тексте",
    "table_reference_missing": "Ссылка на несуществующую таблицу",
    "formula_without_explanation": "Формула без пояснения символов",
    "formula_numbering_gap": "Нарушена нумерация формул",
    "volume_below_minimum": "Объём ниже допустимого",
    "volume_above_maximum": "Объём превышает допустимый",
    "font_size_inconsistency": "Разные размеры шрифта в тексте",
    "table_mass_bold_removed": "Снято сплошное выделение в таблице",
    "long_table_split_warning": "Длинная таблица разрезана для переноса",
    "paragraph_spacing": "Межстрочный интервал/отступы абзаца",
}

# Category of every finding type.
TYPE_CATEGORIES = {
    "missing_structural_section": "Структура",
    "structural_order_violation": "Структура",
    "structural_heading_malformed": "Структура",
    "forbidden_heading": "Заголовки",
    "heading_rename": "Заголовки",
    "heading_number_conflict": "Заголовки",
    "heading_confirm": "Заголовки",
    "possible_missed_heading": "Заголовки",
    "heading_recovered": "Заголовки",
    "figures_renumbered": "Нумерация",
    "tables_renumbered": "Нумерация",
    "caption_renumbered": "Нумерация",
    "formula_numbering_gap": "Нумерация",
    "bibliography_numbering_gap": "Нумерация",
    "bibliography_entries_autonumbered": "Нумерация",
    "citation_without_source": "Библиография",
    "citation_separator_missing": "Библиография",
    "citation_combined": "Библиография",
    "citation_range_suspicious": "Библиография",
    "citation_sequence_issue": "Библиография",
    "source_not_cited": "Библиография",
    "bibliography_missing": "Библиография",
    "bibliography_entry_malformed": "Библиография",
    "bibliography_entries_unrecognised": "Библиография",
    "bibliography_entry_incomplete": "Библиография",
    "figure_not_referenced": "Рисунки и таблицы",
    "figure_reference_missing": "Рисунки и таблицы",
    "table_not_referenced": "Рисунки и таблицы",
    "table_reference_missing": "Рисунки и таблицы",
    "table_mass_bold_removed": "Рисунки и таблицы",
    "long_table_split_warning": "Рисунки и таблицы",
    "formula_without_explanation": "Формулы",
    "formula_number_not_right": "Формулы",
    "appendix_letter_invalid": "Приложения",
    "appendix_letter_gap": "Приложения",
    "appendix_not_referenced": "Приложения",
    "appendix_order_violation": "Приложения",
    "volume_below_minimum": "Объём",
    "volume_above_maximum": "Объём",
    "font_size_inconsistency": "Шрифт и абзацы",
    "paragraph_spacing": "Шрифт и абзацы",
}

# Names of severities and statuses.
SEVERITY_LABELS = {"critical": "Критично", "warning": "Предупреждение", "info": "Информация"}
STATUS_LABELS = {
    "auto_fixed": "Автоисправлено",
    "manual_required": "Требует проверки",
    "accepted": "Принято",
    "rejected": "Отклонено",
}

# Types that ask the user to choose, and types anchored at the fixed text.
CHOICE_TYPES = (
    "heading_confirm", "heading_number_conflict", "possible_missed_heading",
    "caption_renumbered", "figures_renumbered", "tables_renumbered",
)
FIXED_ANCHOR_TYPES = (
    "caption_renumbered", "figures_renumbered", "tables_renumbered",
    "forbidden_heading", "heading_rename",
)


def mapping_table(spark: SparkSession, mapping: dict[str, str], key: str, value: str) -> DataFrame:
    """A driver-side dictionary of a few dozen entries as a table to broadcast."""
    return spark.createDataFrame(list(mapping.items()), f"{key} string, {value} string")
