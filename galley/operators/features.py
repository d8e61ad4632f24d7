"""Paragraph features and per-manuscript statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import text as tx
from galley.scan import following, last, prev, running_sum, scan
from galley.schema import conform
from galley.session import stage

DOC = ["doc_id"]
LIST_LEVELS = 9

# Statistics of a manuscript without usable body text.
DEFAULT_SIZE, DEFAULT_FAMILY, DEFAULT_SPACING = 14.0, "Times New Roman", 1.5


def basic_features(paragraphs: DataFrame) -> DataFrame:
    """Text features that need only the row itself."""
    stripped = F.col("stripped")
    return (
        paragraphs.withColumn("stripped", tx.strip_blank(F.col("text")))
        .withColumn("length", F.length(stripped))
        .withColumn("norm", tx.norm_text(stripped))
        .withColumn("word_count", tx.count_words(F.col("norm")))
        .withColumn("ends_with_period", tx.ends_sentence(stripped))
        .withColumn("is_upper", tx.is_all_caps(stripped))
        .withColumn("is_empty", stripped == "")
        .withColumn("numbering_tokens", tx.numbering_tokens(stripped))
        .withColumn("numbered", F.size("numbering_tokens") > 0)
    )


def enrich(paragraphs: DataFrame) -> DataFrame:
    """Full layout plus every row-local feature the detectors use."""
    return (
        basic_features(conform(paragraphs))
        .withColumn("prefix", tx.heading_prefix(F.col("stripped")))
        .withColumn("native_level", tx.native_heading_level(F.col("style_name")))
        .withColumn("dense", tx.dense_text(F.col("stripped")))
    )


def stored(features: DataFrame, label: str) -> DataFrame:
    """``features`` as a written table that holds every text once.

    ``stripped`` and ``norm`` follow from ``text`` and are taken anew on reading;
    whether there may be runs of white space to look for is written with it.
    """
    rows = features.withColumn("_runs", tx.may_hold_runs(F.col("stripped"))).drop("stripped", "norm")
    rows = stage(rows, label).withColumn("stripped", tx.strip_blank(F.col("text")))
    return rows.withColumn("norm", tx.norm_text(F.col("stripped"), F.col("_runs"))).select(*features.columns)


def derived_numbers(features: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """Add ``derived_number``: from the text, else from list counters.

    ``onto`` gets the column where it is not ``features`` itself, so that the
    counters are taken from the plain table and not from a costlier one.

    A list restarts when other text stands between two of its items, so the
    counters of one unbroken run of list paragraphs are independent of all
    others. Inside a run, the counter of level L counts items of that level
    since the last item of a higher level; if the item right after that one
    was already deeper than L, the missing parent counts as one.
    """
    solid = ~F.col("is_empty")
    level, list_id = F.col("numpr_ilvl"), F.col("numpr_num_id")
    rows = scan(
        features.select("doc_id", "idx", "is_empty", "numbered", "numpr_ilvl", "numpr_num_id"),
        DOC,
        ["idx"],
        _before=prev(F.when(solid, F.struct("numpr_num_id"))),
    )
    members = rows.where(solid & list_id.isNotNull()).select(
        "doc_id",
        "idx",
        "numpr_ilvl",
        (~F.col("numbered") & level.between(0, LIST_LEVELS - 1)).alias("is_item"),
        (~tx.is_true(F.col("_before.numpr_num_id") == list_id)).alias("opens"),
    )
    members = stage(members, "list-paragraphs")
    members = scan(members, DOC, ["idx"], run=last(F.when(F.col("opens"), F.col("idx"))))
    levels = range(LIST_LEVELS)
    run = ["doc_id", "run"]
    items = scan(
        members.where("is_item"),
        run,
        ["idx"],
        _place=running_sum(F.lit(1)),
        _next=following(level),
        **{f"_n{k}": running_sum((level == k).cast("long")) for k in levels},
    )
    items = scan(
        stage(items, "list-items"),
        run,
        ["idx"],
        _first=last(F.when(F.col("_place") == 1, level)),
        **{
            f"_b{k}": last(F.when(level < k, F.struct(F.col(f"_n{k}").alias("n"), F.col("_next").alias("next"))))
            for k in levels
        },
    )

    def counter(k: int):
        opened_by = F.coalesce(F.col(f"_b{k}.next"), F.col("_first"))
        count = F.col(f"_n{k}") - F.coalesce(F.col(f"_b{k}.n"), F.lit(0)) + (opened_by > k).cast("long")
        return F.when(level >= k, count.cast("string"))

    numbers = stage(
        items.select(
            F.col("doc_id").alias("_d"),
            F.col("idx").alias("_i"),
            F.array_join(F.array(*[counter(k) for k in levels]), ".").alias("_number"),
        ),
        "list-numbers",
    )
    rows = features if onto is None else onto
    out = rows.join(numbers, (F.col("doc_id") == F.col("_d")) & (F.col("idx") == F.col("_i")), "left")
    return out.select(
        *rows.columns,
        F.when(F.col("numbered"), tx.join_tokens(F.col("numbering_tokens")))
        .otherwise(F.col("_number"))
        .alias("derived_number"),
    )


def run_ratios(runs: DataFrame) -> DataFrame:
    """Share of bold and of italic characters over runs that are not blank."""
    size = F.length("text")

    def share(flag):
        return F.coalesce(F.try_divide(F.sum(F.when(F.col(flag), size).otherwise(0)), F.sum(size)), F.lit(0.0))

    visible = tx.strip_blank(F.col("text")) != ""
    return (
        runs.withColumn("text", F.when(visible, F.col("text")).otherwise(""))
        .groupBy("doc_id", "idx")
        .agg(share("bold").alias("bold_ratio"), share("italic").alias("italic_ratio"))
    )


def run_font_sizes(runs: DataFrame) -> DataFrame:
    """Largest run size, and the commonest one (0.1 pt; ties: first run)."""
    per_size = (
        runs.where("size_pt IS NOT NULL")
        .groupBy("doc_id", "idx", F.bround("size_pt", 1).alias("size"))
        .agg(F.count("*").alias("n"), F.min("run_no").alias("first"), F.max("size_pt").alias("top"))
    )
    return per_size.groupBy("doc_id", "idx").agg(
        F.max("top").alias("max_font_size_pt"),
        F.max_by("size", F.struct(F.col("n"), -F.col("first"))).alias("modal_font_size_pt"),
    )


def _commonest(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Most frequent value of ``column`` per manuscript, ties by first paragraph."""
    counted = (
        rows.where(F.col(column).isNotNull())
        .groupBy("doc_id", column)
        .agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    )
    return counted.groupBy("doc_id").agg(
        F.max_by(column, F.struct(F.col("n"), -F.col("first"))).alias(out)
    )


def doc_body_modes(features: DataFrame) -> DataFrame:
    """Usual size, family and line spacing of body text, with fallbacks."""
    solid = features.where(~F.col("is_empty"))
    body = solid.where((F.col("length") >= 120) & (F.col("bold_ratio") < 0.2) & ~F.col("numbered"))
    sizes = _commonest(body.where("modal_font_size_pt <> 0"), "modal_font_size_pt", "body_size")
    any_size = _commonest(
        solid.withColumn("size", F.bround("modal_font_size_pt", 1)), "size", "any_size"
    )
    families = _commonest(body.where("font_family <> ''"), "font_family", "body_family")
    spacings = _commonest(body, "line_spacing", "body_spacing")
    docs = features.groupBy("doc_id").agg(F.sum((~F.col("is_empty")).cast("long")).alias("non_empty"))
    return (
        docs.join(sizes, "doc_id", "left")
        .join(any_size, "doc_id", "left")
        .join(families, "doc_id", "left")
        .join(spacings, "doc_id", "left")
        .select(
            "doc_id",
            "non_empty",
            F.coalesce("body_size", "any_size", F.lit(DEFAULT_SIZE)).alias("body_size"),
            F.coalesce("body_family", F.lit(DEFAULT_FAMILY)).alias("body_family"),
            F.coalesce("body_spacing", F.lit(DEFAULT_SPACING)).alias("body_spacing"),
        )
    )


def body_sizes(features: DataFrame) -> DataFrame:
    """Only the usual body size per manuscript, from one pass over the sizes."""
    body = (F.col("length") >= 120) & (F.col("bold_ratio") < 0.2) & ~F.col("numbered")
    raw, rounded = F.col("modal_font_size_pt"), F.bround("modal_font_size_pt", 1)
    rows = features.where(~F.col("is_empty") & raw.isNotNull()).select(
        "doc_id",
        "idx",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("rank"), F.when(body & (raw != 0), raw).alias("size")),
                F.struct(F.lit(0).alias("rank"), rounded.alias("size")),
            )
        ).alias("s"),
    )
    counted = (
        rows.where("s.size IS NOT NULL")
        .groupBy("doc_id", F.col("s.rank").alias("rank"), F.col("s.size").alias("size"))
        .agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    )
    return counted.groupBy("doc_id").agg(
        F.max_by("size", F.struct(F.col("rank"), F.col("n"), -F.col("first"))).alias("body_size")
    )


def numid_group_sizes(features: DataFrame) -> DataFrame:
    """Non-empty paragraphs per list."""
    return (
        features.where(~F.col("is_empty") & F.col("numpr_num_id").isNotNull())
        .groupBy("doc_id", "numpr_num_id")
        .agg(F.count("*").alias("group_size"))
    )


def font_size_histogram(features: DataFrame) -> DataFrame:
    """Non-empty paragraphs per font size (0.1 pt)."""
    return (
        features.where(~F.col("is_empty") & F.col("modal_font_size_pt").isNotNull())
        .groupBy("doc_id", F.bround("modal_font_size_pt", 1).alias("size"))
        .agg(F.count("*").alias("paragraphs"))
    )


def visible_tokens():
    """Numbering tokens of the text, else those of a numeric heading prefix."""
    return (
        F.when(F.col("numbered"), F.col("numbering_tokens"))
        .when(F.col("prefix.kind") == "number", F.col("prefix.tokens"))
        .otherwise(F.array().cast("array<bigint>"))
    )


def neighbour_features(features: DataFrame, of: Column | None = None) -> DataFrame:
    """Length, number, boldness and end of the closest non-empty neighbours, without the texts.

    With ``of``, the paragraphs for which it is true, whose neighbours may be any.
    """
    neighbour = F.when(
        ~F.col("is_empty"),
        F.struct("length", visible_tokens().alias("tokens"), "bold_ratio", "ends_with_period"),
    )
    asked = F.lit(True) if of is None else of
    rows = features.select(
        "doc_id", "idx", "numpr_num_id", "numbered", "numbering_tokens", neighbour.alias("_here"), asked.alias("_asked")
    )
    rows = scan(rows, DOC, ["idx"], before=prev(F.col("_here")), after=following(F.col("_here")))
    return rows.where("_asked").drop("_here", "_asked")
