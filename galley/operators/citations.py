"""Bracketed citations: extraction, order, separators, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.functions import text as tx
from galley.operators.features import DOC
from galley.scan import following, prev, running_sum, scan
from galley.schema import findings
from galley.session import stage

# The dashes that may join a range, and the limit of a plausible range.
_DASH = r"\-‒–—−"
_INNER = rf"\d+(?:\s*[,{_DASH}]\s*\d+)*"
CITATION = rf"(?U)\[({_INNER})\]"
_ADJACENT = rf"(?U)(\[{_INNER}\])\s*(?=\[{_INNER}\])"
_COMBINED = r"(?U)\[(\d+(?:\s*,\s*\d+)+)\]"
_RANGE = rf"(?U)\d+\s*[{_DASH}]\s*\d+"
_RANGE_SPLIT = rf"(?U)\s*[{_DASH}]\s*"
LONG_RANGE = 20
ORDER_LIMIT = 0.3
SHOWN_NUMBERS = 15
#: A range expands level by level, so that no array holds more than this many steps (one level more at the top).
_EXPAND_STEP = 4096
_EXPAND_LEVELS = 4
#: Segments per block grow by this many bits a level (hexadecimal digits); ends of ranges need one number beyond a long.
_LEVEL_BITS = 4
_WIDE = "decimal(20,0)"


def citation_ranges(zoned: DataFrame, starts: DataFrame | None = None, skip: str = "in_title") -> DataFrame:
    """One row per cited range or number: doc_id, idx, token_no, raw_token, part_no, lo, hi.

    ``starts(doc_id, start)``: first paragraph of the source list, where the
    search ends.
    """
    rows = zoned.where(~F.col(skip) & ~F.col("is_empty"))
    if starts is not None:
        limit = starts.select(F.col("doc_id").alias("_d"), F.col("start").alias("_start"))
        rows = rows.join(limit, F.col("doc_id") == F.col("_d"), "left").where(
            "_start IS NULL OR idx < _start"
        )
    tokens = rows.where(F.col("stripped").contains("[")).select(
        "doc_id", "idx", F.posexplode(F.regexp_extract_all("stripped", F.lit(CITATION), 0)).alias("token_no", "raw_token")
    )
    inner = F.regexp_extract("raw_token", CITATION, 1)
    parts = tokens.select("*", F.posexplode(F.split(inner, ",")).alias("part_no", "part"))
    ends = F.split(F.trim(F.col("part")), _RANGE_SPLIT, 2)
    first, final = F.get(ends, 0).try_cast("long"), F.coalesce(F.get(ends, 1), F.get(ends, 0)).try_cast("long")
    return parts.select(
        "doc_id", "idx", F.col("token_no").cast("long").alias("token_no"), "raw_token", F.col("part_no").cast("long").alias("part_no"),
        first.alias("lo"), final.alias("hi"),
    ).where("lo <= hi")


def citations(zoned: DataFrame, starts: DataFrame | None = None, skip: str = "in_title") -> DataFrame:
    """One row per cited number: doc_id, idx, token_no, raw_token, part_no, n_pos, n.

    An absurd range gives as many rows as it names, but never one huge array.
    """
    rows = citation_ranges(zoned, starts, skip).withColumns({"n": F.col("lo"), "_last": F.col("hi") - F.col("lo")})
    for level in range(_EXPAND_LEVELS, -1, -1):
        size = _EXPAND_STEP**level
        steps = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"_last div {size}"))).alias("_step")
        rows = rows.select("*", steps)
        passed = F.col("_step") * size
        rows = rows.withColumns(
            {"n": F.col("n") + passed, "_last": F.least(F.col("_last") - passed, F.lit(size - 1))}
        ).drop("_step")
    return rows.select("doc_id", "idx", "token_no", "raw_token", "part_no", (F.col("n") - F.col("lo")).alias("n_pos"), "n")


def first_mentions(ranges: DataFrame) -> DataFrame:
    """Cited numbers by first mention, in pieces: doc_id, lo, hi, idx, token_no, part_no, raw_token.

    The pieces of a manuscript are disjoint, and all numbers of one have their
    first mention in the same place. The ends of all ranges cut the numbers into
    segments, and each segment takes the earliest place of the ranges over it. A
    range goes to at most 17 blocks of 16, 256, … segments, which hand their
    earliest place down level by level, so no range is expanded, and the number
    of levels follows the logarithm of the segments that one range spans.
    """
    place = F.struct("idx", "token_no", "part_no", "raw_token")
    spans = ranges.groupBy("doc_id", "lo", "hi").agg(F.min(place).alias("_at"))
    spans = stage(
        spans.select("doc_id", F.col("lo").cast(_WIDE).alias("_lo"), (F.col("hi").cast(_WIDE) + 1).cast(_WIDE).alias("_end"), "_at"), "cited-spans"
    )
    cuts = spans.select("doc_id", F.explode(F.array("_lo", "_end")).alias("_cut")).distinct()
    cuts = stage(
        scan(cuts, DOC, ["_cut"], ranged=True, _seg=running_sum(F.lit(1)), _next=following(F.col("_cut"))), "segments"
    )
    width = F.col("_last") - F.col("_first")
    covers = (
        spans.join(cuts.select("doc_id", F.col("_cut").alias("_lo"), F.col("_seg").alias("_first")), ["doc_id", "_lo"])
        .join(cuts.select("doc_id", F.col("_cut").alias("_end"), F.col("_seg").alias("_last")), ["doc_id", "_end"])
        .withColumn("_level", F.length(F.hex(width)) - 1)
        .withColumn("_size", F.expr(f"shiftleft(1L, {_LEVEL_BITS} * _level)"))
    )
    whole = F.sequence(F.col("_first"), F.col("_last") - F.col("_size"), F.col("_size"))
    blocks = covers.select("doc_id", "_level", "_at", F.explode(F.array_append(whole, F.col("_last") - F.col("_size"))).alias("_seg"))
    blocks = stage(blocks.groupBy("doc_id", "_level", "_seg").agg(F.min("_at").alias("_at")), "segment-blocks")
    top = blocks.agg(F.max("_level")).first()[0] or 0
    owned = blocks.where(F.col("_level") == top).drop("_level")
    for level in range(top - 1, -1, -1):
        size = 1 << (_LEVEL_BITS * level)
        parts = F.sequence(F.col("_seg"), F.col("_seg") + F.lit(((1 << _LEVEL_BITS) - 1) * size), F.lit(size).cast("long"))
        handed = owned.select("doc_id", F.explode(parts).alias("_seg"), "_at")
        own = blocks.where(F.col("_level") == level).select("doc_id", "_seg", "_at")
        owned = handed.unionByName(own).groupBy("doc_id", "_seg").agg(F.min("_at").alias("_at"))
    return owned.join(cuts, ["doc_id", "_seg"]).select(
        "doc_id", F.col("_cut").cast("long").alias("lo"), (F.col("_next") - 1).cast("long").alias("hi"), "_at.*"
    )


def citation_order(mentions: DataFrame) -> DataFrame:
    """Inversions in the order of first mentions: doc_id, pairs, inversions, shown.

    Numbers rise within a piece, so they fall at the borders of pieces only.
    """
    size = F.col("hi").cast(_WIDE) - F.col("lo").cast(_WIDE) + 1
    few = F.least(size, F.lit(SHOWN_NUMBERS)).cast("long")
    ordered = scan(
        mentions.withColumn("_few", few),
        DOC,
        ["idx", "token_no", "part_no", "lo"],
        ranged=True,
        before=prev(F.col("hi")),
        rank=running_sum(F.col("_few"), inclusive=False),
    )
    left = F.least(F.col("_few"), F.lit(SHOWN_NUMBERS) - F.col("rank"))
    numbers = F.when(left > 0, F.struct("rank", F.sequence(F.col("lo"), F.col("lo") + (left - 1)).alias("n")))
    shown = F.flatten(F.transform(F.sort_array(F.collect_list(numbers)), lambda s: s["n"]))
    return ordered.groupBy("doc_id").agg(
        (F.sum(size) - 1).cast("double").alias("pairs"),
        F.sum(F.when(F.col("before") > F.col("lo"), 1).otherwise(0)).alias("inversions"),
        F.concat(F.lit("["), F.array_join(shown.cast("array<string>"), ", "), F.lit("]")).alias("shown"),
    )


def citation_sequence(mentions: DataFrame) -> DataFrame:
    rows = citation_order(mentions).where(
        (F.col("pairs") > 0) & (F.col("inversions") / F.col("pairs") >= ORDER_LIMIT)
    )
    return findings(
        rows,
        "citation_sequence_issue",
        "п. 6.15",
        description=F.concat(
            F.lit("Ссылки в тексте встречаются не в порядке возрастания. Порядок первых появлений: "),
            F.col("shown"),
            F.lit("..."),
        ),
    )


def _checked(zoned: DataFrame, skip: str) -> DataFrame:
    return zoned.where(~F.col(skip) & ~F.col("is_empty"))


def citation_separators(zoned: DataFrame, skip: str = "skip") -> DataFrame:
    """Paragraphs with two citations side by side."""
    return findings(
        _checked(zoned, skip).where(F.col("stripped").rlike(_ADJACENT)),
        "citation_separator_missing",
        "п. 6.15",
        status="auto_fixed",
        severity="info",
        description=F.lit("Добавлены запятые между соседними ссылками на источники."),
        paragraph_index=F.col("idx"),
    )


def citation_combined(zoned: DataFrame, skip: str = "skip") -> DataFrame:
    """Paragraphs with several numbers in one bracket."""
    return findings(
        _checked(zoned, skip).where(F.col("stripped").rlike(_COMBINED)),
        "citation_combined",
        "п. 6.15",
        status="auto_fixed",
        severity="info",
        description=F.lit(
            "Несколько номеров источников объединены в одну скобку — разбито на отдельные ссылки."
        ),
        paragraph_index=F.col("idx"),
    )


def suspicious_ranges(zoned: DataFrame, skip: str = "skip") -> DataFrame:
    """Ranges too wide to be meant: doc_id, idx, lo, hi."""
    tokens = _checked(zoned, skip).where(F.col("stripped").contains("[")).select(
        "doc_id", "idx", F.explode(F.regexp_extract_all("stripped", F.lit(CITATION), 1)).alias("inner")
    )
    pairs = tokens.select("doc_id", "idx", F.explode(F.regexp_extract_all("inner", F.lit(_RANGE), 0)).alias("pair"))
    ends = F.split("pair", _RANGE_SPLIT)
    return pairs.select(
        "doc_id", "idx", F.get(ends, 0).try_cast("long").alias("lo"), F.get(ends, 1).try_cast("long").alias("hi")
    ).where(F.col("hi") - F.col("lo") > LONG_RANGE)


def citation_range_suspicious(zoned: DataFrame, skip: str = "skip") -> DataFrame:
    lo, hi = F.col("lo").cast("string"), F.col("hi").cast("string")
    return findings(
        suspicious_ranges(zoned, skip),
        "citation_range_suspicious",
        "п. 6.15",
        description=F.concat(
            F.lit("Подозрительно длинный диапазон ссылок ["), lo, F.lit("-"), hi, F.lit("] — "),
            (F.col("hi") - F.col("lo") + 1).cast("string"),
            F.lit(" источников подряд. Возможно, опечатка вместо ["), lo, F.lit(", "), hi, F.lit("]?"),
        ),
        paragraph_index=F.col("idx"),
        original_text=F.concat(F.lit("["), lo, F.lit("-"), hi, F.lit("]")),
    )


def fix_separators(text):
    """``[1][2]`` becomes ``[1], [2]``; the look-ahead makes one pass enough."""
    return F.regexp_replace(text, _ADJACENT, "$1, ")


def fix_combined(text):
    """``[1,2]`` becomes ``[1], [2]``; other brackets stay."""
    pieces = F.split(text, rf"(?U)(?={_COMBINED[4:]})|(?<=\])")

    def rewrite(piece):
        numbers = F.transform(
            F.split(F.regexp_extract(piece, _COMBINED, 1), ","), lambda n: tx.strip_blank(n)
        )
        spread = F.concat(F.lit("["), F.array_join(numbers, "], ["), F.lit("]"))
        return F.when(piece.rlike(rf"(?U)^{_COMBINED[4:]}$"), spread).otherwise(piece)

    return F.array_join(F.transform(pieces, rewrite), "")
