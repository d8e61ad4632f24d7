"""Word files as tables: intake checks and paragraph features.

Spark lists and reads the files (``binaryFile``) and spreads them over tasks;
the per-file step only walks one archive's XML with the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.schema import PARAGRAPH

# Accepted extension, size limit, archive signature, main part.
EXTENSION = ".docx"
MAX_BYTES = 50 * 1024 * 1024
MAIN_PART = "word/document.xml"
STYLES_PART = "word/styles.xml"

#: Bytes of one part of an archive once unpacked; a part says little of its size before.
MAX_UNPACKED = 64 * 1024 * 1024

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ALIGN = {"both": "justify", "distribute": "justify", "start": "left", "end": "right"}
_OFF = {"0", "false", "off", "none"}
_PARTS = {
    "paragraphs": {k: v for k, v in PARAGRAPH.items() if k != "doc_id"} | {"in_sdt": "boolean"},
    "runs": {"idx": "int", "run_no": "int", "text": "string", "bold": "boolean", "italic": "boolean",
             "size_pt": "double", "font": "string"},
    "table_cells": {"tbl_no": "int", "row_no": "int", "col_no": "int", "text": "string", "bold_runs": "int",
                    "total_runs": "int", "elem_no": "int", "has_vmerge": "boolean"},
    "hidden": {"norm": "string"},
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path``: path, length, content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "modificationTime", "length", "content")
    )


def gate_uploads(files: DataFrame) -> DataFrame:
    """Add ``reason``: why a file is not accepted (null: accepted).

    Name and size are judged from the listing alone, so the content of such
    files is never read; of the others each is opened once, on its way through.
    Content that was refused is dropped.
    """
    early = F.when(~F.lower("path").endswith(EXTENSION), "extension").when(F.col("length") > MAX_BYTES, "too_large")
    fields = ", ".join(f"{name} {kind}" for name, kind in files.dtypes)
    refused = files.where(early.isNotNull()).select(
        *[F.lit(None).cast("binary").alias(c) if c == "content" else F.col(c) for c in files.columns], early.alias("reason")
    )
    opened = files.where(early.isNull()).mapInPandas(_judge_content, f"{fields}, reason string")
    return refused.unionByName(opened)


def _judge_content(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        reasons = pd.Series([_content_problem(c) for c in batch["content"]], index=batch.index, dtype="object")
        yield batch.assign(reason=reasons, content=batch["content"].where(reasons.isna(), None))


class _TooLarge(Exception):
    """A part of an archive unpacks to more than ``MAX_UNPACKED`` bytes."""


def _unpacked(archive: zipfile.ZipFile, part: str) -> bytes:
    """A part's content, of which never more than the limit is held."""
    if archive.getinfo(part).file_size > MAX_UNPACKED:
        raise _TooLarge(part)
    with archive.open(part) as stream:
        content = stream.read(MAX_UNPACKED + 1)
    if len(content) > MAX_UNPACKED:
        raise _TooLarge(part)
    return content


def _content_problem(content: bytes) -> str | None:
    if bytes(content[:4]) != b"PK\x03\x04":
        return "signature"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = archive.namelist()
            if MAIN_PART not in names:
                return "no_main_part"
            if ElementTree.fromstring(_unpacked(archive, MAIN_PART)).find(f"{_W}body") is None:
                return "damaged"
            if STYLES_PART in names:
                ElementTree.fromstring(_unpacked(archive, STYLES_PART))
    except _TooLarge:
        return "too_large_unpacked"
    except (zipfile.BadZipFile, zlib.error, EOFError, ElementTree.ParseError):
        return "damaged"
    except (RuntimeError, NotImplementedError):
        return "encrypted"
    return None


def read_manuscripts(files: DataFrame) -> dict[str, DataFrame]:
    """Accepted files as tables ``paragraphs``, ``runs``, ``table_cells`` and ``hidden``.

    ``files(doc_id, content)``. Each table is one pass over the files that
    yields flat rows, so no table is held whole anywhere. A file that cannot be
    parsed yields no rows; ``gate_uploads`` names the reason.
    """
    return {name: _part(files, name) for name in _PARTS}


def _part(files: DataFrame, name: str) -> DataFrame:
    columns = _PARTS[name]
    schema = f"doc_id {files.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in columns.items())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                found = _parse(content).get(name)
                if found:
                    frame = pd.DataFrame(found, columns=list(columns))
                    frame.insert(0, "doc_id", doc_id)
                    yield _nullable(frame, columns)

    return files.select("doc_id", "content").mapInPandas(rows, schema)


def _nullable(frame: pd.DataFrame, columns: dict[str, str]) -> pd.DataFrame:
    for column, kind in columns.items():
        if kind == "int":
            frame[column] = frame[column].astype("Int32")
        elif kind == "double":
            frame[column] = frame[column].astype("float64")
        elif kind == "boolean":
            frame[column] = frame[column].astype("boolean")
    return frame


def _parse(content: bytes) -> dict[str, list[dict]]:
    """Rows of all tables of one file; empty where the file cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = set(archive.namelist())
            body = ElementTree.fromstring(_unpacked(archive, MAIN_PART)).find(f"{_W}body")
            styles = _styles(_unpacked(archive, STYLES_PART)) if STYLES_PART in names else {}
    except (_TooLarge, zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, KeyError, ElementTree.ParseError):
        return {}
    return _walk(body, styles) if body is not None else {}


def _value(node, path: str, attribute: str = "val") -> str | None:
    found = node.find("/".join(f"{_W}{p}" for p in path.split("/"))) if node is not None else None
    return found.get(f"{_W}{attribute}") if found is not None else None


def _on(node, path: str) -> bool:
    found = node.find(f"{_W}{path}") if node is not None else None
    return found is not None and (found.get(f"{_W}val") or "on").lower() not in _OFF


def _scaled(raw: str | None, unit: float) -> float | None:
    try:
        return float(raw) * unit if raw is not None else None
    except ValueError:
        return None


def _number(raw: str | None) -> int | None:
    return int(raw) if raw is not None and re.fullmatch(r"-?\d+", raw) else None


def _styles(xml: bytes) -> dict[str, dict]:
    """Paragraph styles: name, parent and the attributes that paragraphs inherit."""
    out = {}
    for style in ElementTree.fromstring(xml).iter(f"{_W}style"):
        props, run = style.find(f"{_W}pPr"), style.find(f"{_W}rPr")
        out[style.get(f"{_W}styleId")] = {
            "name": _value(style, "name") or "",
            "base": _value(style, "basedOn"),
            "default": style.get(f"{_W}default") == "1" and style.get(f"{_W}type") == "paragraph",
            "outline": _number(_value(props, "outlineLvl")),
            "before": _scaled(_value(props, "spacing", "before"), 1 / 20),
            "after": _scaled(_value(props, "spacing", "after"), 1 / 20),
            "size": _scaled(_value(run, "sz"), 1 / 2),
            "font": _value(run, "rFonts", "ascii"),
        }
    return out


def _inherited(styles: dict, style_id: str | None, key: str):
    seen = set()
    while style_id in styles and style_id not in seen:
        seen.add(style_id)
        if styles[style_id][key] is not None:
            return styles[style_id][key]
        style_id = styles[style_id]["base"]
    return None


def _text(node) -> str:
    out = []
    for item in node.iter():
        if item.tag == f"{_W}t":
            out.append(item.text or "")
        elif item.tag == f"{_W}tab" and not item.attrib:
            out.append("\t")
        elif item.tag in (f"{_W}br", f"{_W}cr") and item.get(f"{_W}type") in (None, "textWrapping"):
            out.append("\n")
    return "".join(out)


def _run_rows(paragraph) -> list[dict]:
    rows = []
    for node in paragraph.findall(f"{_W}r"):
        props = node.find(f"{_W}rPr")
        rows.append({
            "run_no": len(rows), "text": _text(node), "bold": _on(props, "b"), "italic": _on(props, "i"),
            "size_pt": _scaled(_value(props, "sz"), 1 / 2), "font": _value(props, "rFonts", "ascii"),
        })
    return rows


def _share(runs: list[dict], flag: str) -> float:
    shown = [r for r in runs if r["text"].strip()]
    total = sum(len(r["text"]) for r in shown)
    return sum(len(r["text"]) for r in shown if r[flag]) / total if total else 0.0


def _paragraph(node, styles: dict, default: str | None) -> tuple[dict, list[dict]]:
    props = node.find(f"{_W}pPr")
    style = _value(props, "pStyle") or default
    runs = _run_rows(node)
    sizes = [r["size_pt"] for r in runs if r["size_pt"] is not None]
    own_size = styles.get(style, {}).get("size")
    if not sizes and own_size is not None:
        sizes = [own_size]
    rounded = [round(s, 1) for s in sizes]
    fonts = [r["font"] for r in runs if r["font"]]
    outline = _number(_value(props, "outlineLvl"))
    first, hanging = _value(props, "ind", "firstLine"), _value(props, "ind", "hanging")
    indent = _scaled(first, 2.54 / 1440) if hanging is None else -(_scaled(hanging, 2.54 / 1440) or 0.0)
    left = _value(props, "ind", "left") or _value(props, "ind", "start")
    before = _scaled(_value(props, "spacing", "before"), 1 / 20)
    after = _scaled(_value(props, "spacing", "after"), 1 / 20)
    align = _value(props, "jc")
    text = _text(node)
    instructions = " ".join(i.text or "" for i in node.iter(f"{_W}instrText"))
    row = {
        "text": text,
        "alignment": _ALIGN.get(align, align),
        "first_line_indent_cm": indent,
        "left_indent_cm": _scaled(left, 2.54 / 1440),
        "max_font_size_pt": max(sizes) if sizes else None,
        "modal_font_size_pt": max(rounded, key=rounded.count) if rounded else None,
        "font_family": fonts[0] if fonts else styles.get(style, {}).get("font"),
        "bold_ratio": _share(runs, "bold"),
        "italic_ratio": _share(runs, "italic"),
        "in_table": False,
        "style_name": styles.get(style, {}).get("name", ""),
        "has_tab": "\t" in text,
        "numpr_ilvl": _number(_value(props, "numPr/ilvl")),
        "numpr_num_id": _number(_value(props, "numPr/numId")),
        "outline_level": outline if outline is not None else styles.get(style, {}).get("outline"),
        "has_page_break_before": _on(props, "pageBreakBefore"),
        "has_image": any(next(node.iter(f"{_W}{t}"), None) is not None for t in ("drawing", "pict", "object")),
        "has_page_reference": "PAGEREF" in instructions or " TOC " in instructions or "TOC \\o" in instructions,
        "run_fonts": sorted({r["font"].strip().lower() for r in runs if r["font"]}),
        "space_before_pt": before if before is not None else (_inherited(styles, style, "before") or 0.0),
        "space_after_pt": after if after is not None else (_inherited(styles, style, "after") or 0.0),
        "line_spacing": _scaled(_value(props, "spacing", "line"), 1 / 240),
        "has_section_break": props is not None and props.find(f"{_W}sectPr") is not None,
    }
    return row, runs


def _cells(table, tbl_no: int, elem_no: int) -> list[dict]:
    rows = []
    for row_no, tr in enumerate(table.findall(f"{_W}tr")):
        for col_no, tc in enumerate(tr.findall(f"{_W}tc")):
            runs = [r for p in tc.findall(f"{_W}p") for r in _run_rows(p) if r["text"].strip()]
            props = tc.find(f"{_W}tcPr")
            rows.append({
                "tbl_no": tbl_no, "row_no": row_no, "col_no": col_no, "elem_no": elem_no,
                "text": "\n".join(_text(p) for p in tc.findall(f"{_W}p")),
                "bold_runs": sum(r["bold"] for r in runs), "total_runs": len(runs),
                "has_vmerge": props is not None and props.find(f"{_W}vMerge") is not None,
            })
    return rows


def _body_elements(body) -> Iterator[tuple]:
    """Paragraphs and tables in order; contents controls are opened, others are hidden."""
    for child in body:
        if child.tag in (f"{_W}p", f"{_W}tbl"):
            yield child, False
        elif child.tag == f"{_W}sdt":
            content = child.find(f"{_W}sdtContent")
            gallery = " ".join(
                (g.get(f"{_W}val") or "").lower() for g in child.iter(f"{_W}docPartGallery")
            )
            fields = " ".join(i.text or "" for i in child.iter(f"{_W}instrText"))
            contents = "contents" in gallery or "оглавлени" in gallery or " TOC " in fields or "TOC \\o" in fields
            for inner in content if content is not None else ():
                yield inner, not contents


def _walk(body, styles: dict) -> dict[str, list[dict]]:
    default = next((k for k, s in styles.items() if s["default"]), None)
    paragraphs, runs, cells, hidden = [], [], [], []
    tables = elem_no = 0
    for node, concealed in _body_elements(body):
        if concealed:
            norm = " ".join(_text(node).lower().split())
            if norm:
                hidden.append({"norm": norm})
            continue
        if node.tag == f"{_W}tbl":
            cells += _cells(node, tables, elem_no)
            tables += 1
            if paragraphs:
                paragraphs[-1]["table_follows"] = True
                for row in reversed(paragraphs):
                    row["next_is_table"] = True
                    if row["text"].strip():
                        break
        else:
            row, own = _paragraph(node, styles, default)
            idx = len(paragraphs)
            row |= {"idx": idx, "elem_no": elem_no, "table_follows": False, "next_is_table": False, "in_sdt": False}
            paragraphs.append(row)
            runs += [r | {"idx": idx} for r in own]
        elem_no += 1
    return {"paragraphs": paragraphs, "runs": runs, "table_cells": cells, "hidden": hidden}


def with_doc_id(files: DataFrame) -> DataFrame:
    """Add ``doc_id``, a 256-bit hash of the file path, so that no two files are taken for one."""
    return files.withColumn("doc_id", F.sha2("path", 256))


def paragraphs_from_text(docs: DataFrame) -> DataFrame:
    """Plain text as paragraphs: one row per line, whole text, doc_id, idx, text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))

