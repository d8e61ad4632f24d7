"""Whole reports over a corpus: check only, and revise."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import text as tx
from galley.operators import (
    appendix, bibliography, body, captions, citations, features, formulas, headings, layout, revision, structure, tables, zones,
)
from galley.rules import default_rules
from galley.schema import PARAGRAPH, conform
from galley.session import stage


@dataclass
class Manuscripts:
    """Tables of a corpus; only ``paragraphs`` is required."""

    paragraphs: DataFrame
    cells: DataFrame | None = None
    hidden: DataFrame | None = None
    table_pairs: DataFrame | None = None


@dataclass
class Detection:
    """Scored paragraphs and accepted headings, both written tables."""

    scored: DataFrame
    headings: DataFrame
    docs: DataFrame


def zoned(paragraphs: DataFrame, rules: dict | None = None) -> DataFrame:
    """Features and zones of every paragraph.

    The features are written once: finding the zones takes several passes over
    a few of their columns.
    """
    return zones.mark_zones(features.stored(features.enrich(paragraphs), "features"), rules or default_rules())


def detect(paragraphs: DataFrame, rules: dict | None = None) -> Detection:
    """Score the corpus once, write it, and accept headings from the written table."""
    rules = rules or default_rules()
    base = features.stored(features.enrich(paragraphs), "features")
    scored = features.stored(headings.score(base, rules), "scored")
    accepted = stage(headings.detect(scored), "headings")
    return Detection(scored, accepted, scored.select("doc_id").distinct())


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _hidden(data: Manuscripts) -> DataFrame:
    if data.hidden is not None:
        return data.hidden.select("doc_id", "norm")
    return data.paragraphs.sparkSession.createDataFrame([], "doc_id long, norm string")


def _heading_findings(found: Detection, rules: dict) -> list[DataFrame]:
    return [
        headings.heading_confirm(found.scored),
        headings.semantic_confirm(found.scored),
        headings.heading_recovered(found.scored),
        headings.missed_headings(found.scored, found.headings),
        structure.forbidden_heading(found.headings, rules),
        structure.heading_rename(found.headings, rules),
    ]


def common_findings(data: Manuscripts, found: Detection, rules: dict, full: bool) -> list[DataFrame]:
    """Checks on the original paragraphs, shared by both reports."""
    rows, heads, docs = found.scored, found.headings, found.docs
    bounds = stage(zones.references_range(rows, heads, rules), "references")
    ranges = stage(citations.citation_ranges(rows, bounds), "cited-ranges")
    mentions = stage(citations.first_mentions(ranges), "first-mentions")
    listed = stage(bibliography.in_references(rows, bounds), "sources")
    parts = [structure.structural_heading_malformed(structure.malformed_headings(rows, rules), full)]
    parts += _heading_findings(found, rules)
    if (rules.get("numbering_rules") or {}).get("validate_citation_sequence", True):
        parts.append(citations.citation_sequence(mentions))
    parts += [
        citations.citation_separators(rows),
        citations.citation_combined(rows),
        citations.citation_range_suspicious(rows),
    ]
    if full:
        typed = stage(bibliography.autonumber(listed), "autonumbered")
        parts.append(bibliography.autonumbered_notice(typed))
        listed = stage(structure.apply_text(listed.withColumnRenamed("stripped", "text"), typed).withColumnRenamed("text", "stripped"), "sources")
    entries = stage(bibliography.bib_entries(listed), "entries")
    parts += [
        bibliography.bib_malformed(listed),
        bibliography.bib_missing(docs, bounds, entries),
        bibliography.bib_numbering_gap(entries),
        bibliography.citation_without_source(mentions, entries),
        bibliography.source_not_cited(ranges, entries),
        bibliography.bib_incomplete(entries),
    ]
    positions = stage(structure.section_positions(rows, heads, _hidden(data), rules), "sections")
    parts += [
        structure.missing_section(docs, positions),
        structure.section_order(docs, positions),
        structure.optional_before_intro(docs, positions),
    ]
    letters = stage(appendix.appendix_letters(heads), "appendices")
    mentions = stage(appendix.appendix_mentions(rows, letters), "appendix-mentions")
    parts += [
        appendix.appendix_letter_invalid(letters),
        appendix.appendix_letter_gap(letters),
        appendix.appendix_not_referenced(letters, mentions),
        appendix.appendix_order(letters, mentions),
    ]
    equations = stage(formulas.formulas(rows, heads), "formulas")
    parts += [
        formulas.formula_number_not_right(equations),
        formulas.formula_without_explanation(equations),
        formulas.formula_numbering_gap(equations),
        layout.volume_limits(layout.estimate_pages(rows, data.cells), rules),
        layout.font_size_inconsistency(rows, rules),
        layout.paragraph_spacing(rows, heads, rules),
    ]
    return parts


def _reference_findings(rows: DataFrame, numbered_captions: DataFrame) -> list[DataFrame]:
    resolved = stage(
        captions.resolve_references(captions.text_references(rows, numbered_captions), numbered_captions), "references"
    )
    return [
        captions.not_referenced(numbered_captions, resolved),
        captions.dangling_references(numbered_captions, resolved),
    ]


def check_report(data: Manuscripts, rules: dict | None = None, found: Detection | None = None) -> DataFrame:
    """All findings of a check without changes; captions are numbered virtually."""
    rules = rules or default_rules()
    found = found or detect(data.paragraphs, rules)
    parts = common_findings(data, found, rules, full=False)
    shown = stage(captions.all_captions(found.scored, found.headings, rules), "captions")
    parts += _reference_findings(found.scored, shown)
    parts.append(headings.heading_number_conflict(found.headings))
    return _union(parts)


@dataclass
class Revision:
    """Revised paragraphs (``idx`` is the new place, ``old_idx`` the one in the original), findings, links and contents."""

    paragraphs: DataFrame
    findings: DataFrame
    links: DataFrame
    outline: DataFrame


def revise(data: Manuscripts, rules: dict | None = None) -> Revision:
    """Rewrite the corpus and report: fixed findings, and checks on the new text.

    Order: section titles cleaned, headings normalised and renamed, chapter
    words dropped, appendix titles raised, table captions moved above their
    tables, captions renumbered, references rewritten, citations, formulas and
    spaces tidied, blank paragraphs dropped, one blank set after tables and figure
    captions; accepted headings get the style and outline level of their level,
    those of the first level a page break, and other paragraphs lose theirs.
    References are checked on the revised text, heading numbers on the final one.

    Paragraphs that the revision adds have no ``old_idx``. Captions typed in a
    table need ``elem_no`` in ``data.cells``; the cells themselves stay as given.
    """
    rules = rules or default_rules()
    given = data.paragraphs
    asked = stage(structure.may_hold_malformed(conform(given), rules), "may-be-malformed")
    first = zoned(given.join(asked, ["doc_id"], "left_semi"), rules)
    malformed = stage(structure.malformed_headings(first, rules), "malformed")
    cleaned = stage(
        structure.apply_text(given, malformed.select("doc_id", "idx", F.col("cleaned").alias("new_text"))), "cleaned"
    )
    found = detect(cleaned, rules)
    parts = common_findings(Manuscripts(cleaned, data.cells, data.hidden), found, rules, full=True)[1:]
    parts.append(structure.structural_heading_malformed(malformed, True))

    work, heads = found.scored, found.headings
    titled = structure.apply_text(work, _title_changes(work, heads, rules))
    # Changes of few paragraphs are laid over the scored ones; all texts are written once, with the last of them.
    words = stage(revision.chapter_word_changes(_refreshed(titled)), "chapter-words")
    titled = structure.apply_text(titled, words)
    raised = stage(revision.appendix_title_rows(_refreshed(titled)).groupBy("doc_id", "idx").agg(F.min("new_text").alias("new_text")), "appendix-titles")
    titled = stage(_refreshed(structure.apply_text(titled, raised)).withColumn("given_idx", F.col("idx")), "titled")
    titled, table_places = body.with_captions_above(titled, data.cells)
    titled = stage(_refreshed(titled), "captions-above")
    heads = stage(_placed(found.headings, titled), "placed-headings")
    breaks = stage(_placed(revision.page_break_plan(work, headings.may_apply(found.headings)), titled), "page-breaks")
    shown = stage(captions.all_captions(titled, heads, rules, kinds=("figure", "table", "listing")), "captions")
    parts.append(captions.caption_renumbered(shown))
    referable = shown.where("kind <> 'listing'")
    changes, links = captions.rewrite_references(titled.where("NOT in_title"), referable)
    changes = changes.unionByName(shown.select("doc_id", "idx", captions.caption_text().alias("new_text")))
    equations = _placed(formulas.fix_alignment(formulas.formulas(work, found.headings)).select("doc_id", "idx"), titled)
    plain = zones.listing_code_lines(titled).unionByName(heads.select("doc_id", "idx"))
    tidied = _mark(_mark(titled, stage(equations, "equations"), "_formula"), stage(plain, "untouched"), "_keep")
    tidied = structure.apply_text(tidied, stage(changes, "caption-changes")).withColumn("text", _tidy(F.col("text")))
    tidied = stage(_refreshed(tidied.drop("_formula", "_keep")), "tidied")
    parts += _reference_findings(tidied, referable)
    if data.table_pairs is not None and data.cells is not None:
        parts += [
            tables.table_mass_bold_removed(data.cells, data.table_pairs),
            tables.long_table_split_warning(data.cells, data.table_pairs),
        ]
    styled = _restyled(revision.drop_empty_paragraphs(_broken(tidied, breaks)), heads).drop("old_idx")
    final = body.with_blanks_after(stage(styled, "styled"), table_places)
    final = stage(_refreshed(final).withColumnRenamed("given_idx", "old_idx"), "revised")
    parts.append(recheck_headings(final.select(*PARAGRAPH), rules))
    revised = final.select(*[c for c in given.columns if c in final.columns], "old_idx")
    return Revision(revised, _union(parts), links, revision.toc_outline(final, rules))


def _placed(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``found(doc_id, idx, …)`` of the given paragraphs with ``idx`` in the new order of ``rows``."""
    new = rows.where("given_idx IS NOT NULL").select("doc_id", F.col("given_idx").alias("idx"), F.col("idx").alias("_new"))
    return found.join(new, ["doc_id", "idx"]).withColumn("idx", F.col("_new")).select(*found.columns)


def _broken(rows: DataFrame, breaks: DataFrame) -> DataFrame:
    """Page breaks before the paragraphs named in ``breaks(doc_id, idx)``."""
    marked = _mark(rows, breaks, "_break")
    return marked.withColumn("has_page_break_before", F.col("has_page_break_before") | F.col("_break")).drop("_break")


def _restyled(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Style and outline level as the accepted headings have them, whose ``idx`` is the old place."""
    levels = headings.may_apply(heads).select(F.col("doc_id").alias("_hd"), F.col("idx").alias("_hi"), F.col("level").alias("_level"))
    joined = rows.join(levels, (F.col("doc_id") == F.col("_hd")) & (F.col("old_idx") == F.col("_hi")), "left")
    styled = F.lower(F.coalesce("style_name", F.lit(""))).rlike(r"^(heading|заголовок)\s*\d+$")
    style = (
        F.when(F.col("_level").isNotNull(), F.concat(F.lit("Heading "), F.col("_level").cast("string")))
        .when(styled, F.lit("Normal"))
        .otherwise(F.col("style_name"))
    )
    outline = (F.col("_level") - 1).cast(rows.schema["outline_level"].dataType)
    return joined.withColumn("style_name", style).withColumn("outline_level", outline).select(*rows.columns)


def _title_changes(work: DataFrame, heads: DataFrame, rules: dict) -> DataFrame:
    """New text of headings, unnumbered sources and list items; headings count first."""
    bounds = zones.references_range(work, heads, rules)
    typed = bibliography.autonumber(bibliography.in_references(work, bounds))
    own = work.select("doc_id", "idx", "text", "numpr_ilvl", "derived_number")
    titles = own.join(headings.may_apply(heads).select("doc_id", "idx"), ["doc_id", "idx"], "left_semi")
    titles = structure.apply_text(titles, structure.title_fixes(heads, rules))
    ranked = [
        revision.normalise_headings(titles, derived=True),
        typed.select("doc_id", "idx", "new_text"),
        revision.keep_list_numbers(work, heads),
    ]
    rows = _union([part.withColumn("rank", F.lit(i)) for i, part in enumerate(ranked)])
    first = rows.groupBy("doc_id", "idx").agg(F.min_by("new_text", "rank").alias("new_text"))
    return stage(first, "title-changes")


def _mark(rows: DataFrame, places: DataFrame, name: str) -> DataFrame:
    """Add a flag for the rows named in ``places(doc_id, idx)``."""
    at = places.select(F.col("doc_id").alias("_md"), F.col("idx").alias("_mi")).distinct()
    joined = rows.join(at, (F.col("doc_id") == F.col("_md")) & (F.col("idx") == F.col("_mi")), "left")
    return joined.withColumn(name, F.col("_mi").isNotNull()).drop("_md", "_mi")


def _tidy(text: Column) -> Column:
    """Citations, formula numbers and spaces, each only where it may be touched."""
    cited = F.when(
        ~F.col("skip") & text.contains("["), citations.fix_separators(citations.fix_combined(text))
    ).otherwise(text)
    aligned = F.when(F.col("_formula"), formulas.align_number(cited)).otherwise(cited)
    return F.when(F.col("_keep") | F.col("in_title"), aligned).otherwise(revision.normalise_spaces(aligned))


def _refreshed(rows: DataFrame) -> DataFrame:
    """Recompute the text features after a change of text."""
    fresh = features.basic_features(rows)
    return fresh.withColumn("prefix", tx.heading_prefix(F.col("stripped"))).select(*rows.columns)


def recheck_headings(paragraphs: DataFrame, rules: dict | None = None) -> DataFrame:
    """Number conflicts of revised paragraphs."""
    return headings.heading_number_conflict(detect(paragraphs, rules).headings)
