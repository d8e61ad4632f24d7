"""Table layouts shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARAGRAPH = {
    "doc_id": "long",
    "idx": "int",
    "text": "string",
    "alignment": "string",
    "first_line_indent_cm": "double",
    "left_indent_cm": "double",
    "max_font_size_pt": "double",
    "modal_font_size_pt": "double",
    "font_family": "string",
    "bold_ratio": "double",
    "italic_ratio": "double",
    "in_table": "boolean",
    "style_name": "string",
    "has_tab": "boolean",
    "numpr_ilvl": "int",
    "numpr_num_id": "int",
    "outline_level": "int",
    "has_page_break_before": "boolean",
    "has_image": "boolean",
    "has_page_reference": "boolean",
    "table_follows": "boolean",
    "next_is_table": "boolean",
    "run_fonts": "array<string>",
    "space_before_pt": "double",
    "space_after_pt": "double",
    "line_spacing": "double",
    "has_section_break": "boolean",
    "elem_no": "int",
}

_DEFAULTS = {
    "bold_ratio": 0.0,
    "italic_ratio": 0.0,
    "in_table": False,
    "style_name": "Normal",
    "has_page_break_before": False,
    "has_image": False,
    "has_page_reference": False,
    "table_follows": False,
    "next_is_table": False,
    "space_before_pt": 0.0,
    "space_after_pt": 0.0,
    "has_section_break": False,
}

FINDING = {
    "doc_id": "long",
    "type": "string",
    "rule_reference": "string",
    "severity": "string",
    "status": "string",
    "description": "string",
    "paragraph_index": "int",
    "section_title": "string",
    "original_text": "string",
    "fixed_text": "string",
    "fix_options": "array<string>",
    "caused_by_index": "int",
    "detector_signals": "array<string>",
    "supervisor_comment": "string",
}


def conform(paragraphs: DataFrame) -> DataFrame:
    """Bring a paragraph table to the full layout; absent columns get neutral values."""
    have = set(paragraphs.columns)
    out = []
    for name, kind in PARAGRAPH.items():
        if name in have:
            value = F.col(name).cast(kind)
            if name in _DEFAULTS:
                value = F.coalesce(value, F.lit(_DEFAULTS[name]).cast(kind))
        elif name == "has_tab":
            value = F.col("text").contains("\t")
        elif name == "elem_no":
            value = F.col("idx").cast("int")
        elif name == "run_fonts":
            value = F.array().cast(kind)
        else:
            value = F.lit(_DEFAULTS.get(name)).cast(kind)
        out.append(value.alias(name))
    return paragraphs.select(*out)


def findings(
    rows: DataFrame,
    type: str | Column,
    rule: str,
    status: str | Column = "manual_required",
    severity: str | Column = "warning",
    **values: Column,
) -> DataFrame:
    """Rows of the findings table; ``values`` name the columns that are not null."""
    fixed = {"type": type, "rule_reference": rule, "status": status, "severity": severity, **values}
    out = [F.col("doc_id").cast("long").alias("doc_id")]
    for name, kind in FINDING.items():
        if name == "doc_id":
            continue
        value = fixed.get(name)
        column = value if isinstance(value, Column) else F.lit(value)
        out.append(column.cast(kind).alias(name))
    return rows.select(*out)
