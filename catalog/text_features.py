"""Sources, text features and zones."""

from pyspark.sql import functions as F

from catalog.core import RULES, query
from galley import rules as ru
from galley.functions import text as tx
from galley.operators import features, zones
from galley.sources import gold
from galley.sources.docx import paragraphs_from_text
from oracle.base import norm, squash

_TOKENS = lambda c: F.array_join(F.transform(c, lambda t: t.cast("string")), ",")


def _lines(f):
    return f.base_lines.withColumnsRenamed({"ln": "idx", "txt": "text"})


@query("S3_paragraphs_from_text", "doc_id:l idx:l text:s", "SELECT doc_id, ln AS idx, txt AS text FROM base_lines")
def _(f):
    from galley.fixtures import table
    return paragraphs_from_text(table(f.spark, f.dir, "documents"))


@query("S4_rules_tables", "kind:s key:s value:s paragraphs:l", """
    SELECT r.kind, r.key, r.value, count(z.idx) AS paragraphs FROM (
      SELECT 'alias' AS kind, concat(section, ':', alias) AS key, alias AS name, CASE WHEN NOT is_canonical THEN canonical END AS value FROM section_names
      UNION ALL SELECT 'forbidden', key_norm, key_norm, replacement FROM forbidden_names) r LEFT JOIN feat z ON z.norm = r.name
    GROUP BY r.kind, r.key, r.value""")
def _(f):
    # Each rule with the number of paragraphs that read like it.
    table = ru.rule_table(f.spark, RULES).withColumn("name", F.substring_index("key", ":", -1))
    # Only paragraphs that read like a rule are counted; the rules are one small dictionary.
    names = F.broadcast(table.select(F.col("name").alias("norm")).distinct())
    used = f.zoned.select("norm").join(names, "norm", "left_semi").groupBy("norm").agg(F.count("*").alias("n"))
    rows = table.join(used, F.col("norm") == F.col("name"), "left")
    return rows.select("kind", "key", "value", F.coalesce("n", F.lit(0)).alias("paragraphs"))


@query("S8_draft_annotations", "doc_id:l type:s detected:b paragraph_index:l severity:s note:s",
       "SELECT doc_id, type, true AS detected, paragraph_index, severity, concat('section=', substr(section_title, 1, 60)) AS note FROM found")
def _(f):
    return gold.draft_annotations(f.findings)


@query("P1_unicode_strip", "doc_id:l idx:l stripped:s", "SELECT doc_id, idx, stripped FROM line_basic")
def _(f):
    return _lines(f).withColumn("stripped", tx.strip_blank(F.col("text")))


@query("P2_basic_features", "doc_id:l idx:l length:l word_count:l per:b is_upper:b is_empty:b",
       "SELECT doc_id, idx, length, word_count, per, is_upper, is_empty FROM feat")
def _(f):
    return features.basic_features(f.paragraphs).withColumnRenamed("ends_with_period", "per")


@query("P3_numbering_tokens", "doc_id:l idx:l tokens:s", "SELECT doc_id, idx, array_to_string(ntok, ',') AS tokens FROM feat")
def _(f):
    rows = features.basic_features(f.paragraphs)
    return rows.withColumn("tokens", _TOKENS("numbering_tokens"))


@query("P4_heading_prefix", "doc_id:l idx:l kind:s number:s level:l title:s word:s",
       "SELECT doc_id, idx, pk AS kind, pnum AS number, plevel AS level, ptitle AS title, pword AS word FROM feat WHERE pk IS NOT NULL")
def _(f):
    p = features.basic_features(f.paragraphs).withColumn("prefix", tx.heading_prefix(F.col("stripped")))
    return p.where("prefix IS NOT NULL").select("doc_id", "idx", "prefix.*")


@query("P5_roman_to_int", "doc_id:l idx:l word:s value:l", """
    SELECT * FROM (SELECT doc_id, idx, word, %s AS value FROM (SELECT doc_id, ln AS idx, unnest(regexp_extract_all(lower(txt), '[ivxlcdm]+')) AS word FROM base_lines))
    WHERE value IS NOT NULL""" % __import__("oracle.base", fromlist=["roman"]).roman("word"))
def _(f):
    words = f.base_lines.select("doc_id", F.col("ln").alias("idx"), F.explode(F.regexp_extract_all(F.lower("txt"), F.lit("[ivxlcdm]+"), 0)).alias("word"))
    return words.withColumn("value", tx.roman_to_int(F.col("word"))).where("value IS NOT NULL")


@query("P6_norm_text", "doc_id:l idx:l norm:s", f"SELECT doc_id, idx, {norm('text')} AS norm FROM paras")
def _(f):
    return f.paragraphs.withColumn("norm", tx.norm_text(F.col("text")))


@query("P7_squash_text", "doc_id:l idx:l squashed:s", f"SELECT doc_id, idx, {squash('text')} AS squashed FROM paras")
def _(f):
    return f.paragraphs.withColumn("squashed", tx.squash_text(F.col("text")))


@query("P8_derived_numbers", "doc_id:l idx:l derived_number:s", """
    SELECT f.doc_id, f.idx, coalesce(CASE WHEN len(ntok) > 0 THEN array_to_string(ntok, '.') END, auto_number) AS derived_number
    FROM feat f LEFT JOIN list_numbers a ON f.doc_id = a.doc_id AND f.idx = a.idx""")
def _(f):
    return features.derived_numbers(f.zoned)


@query("P9_run_ratios", "doc_id:l idx:l bold_ratio:d italic_ratio:d", """
    SELECT doc_id, idx, round(coalesce(sum(CASE WHEN bold THEN n ELSE 0 END) / nullif(sum(n), 0), 0), 6) AS bold_ratio,
      round(coalesce(sum(CASE WHEN italic THEN n ELSE 0 END) / nullif(sum(n), 0), 0), 6) AS italic_ratio FROM (
      SELECT doc_id, ln AS idx, CASE WHEN trim(substr(txt, k * 20 + 1, 20)) = '' THEN 0 ELSE length(substr(txt, k * 20 + 1, 20)) END AS n,
        (doc_id + ln + k) % 3 = 0 AS bold, (doc_id + k) % 4 = 0 AS italic FROM (SELECT *, unnest(range(0, (greatest(length(txt), 1) - 1) // 20 + 1)) AS k FROM base_lines))
    GROUP BY doc_id, idx""")
def _(f):
    rows = features.run_ratios(f.runs)
    return rows.withColumns({c: F.round(c, 6) for c in ("bold_ratio", "italic_ratio")})


@query("P10_run_font_sizes", "doc_id:l idx:l max_font_size_pt:d modal_font_size_pt:d", """
    SELECT doc_id, idx, max(size) AS max_font_size_pt, arg_max(round(size, 1), [n, -first]) AS modal_font_size_pt FROM (
      SELECT *, count(*) OVER (PARTITION BY doc_id, idx, round(size, 1)) AS n, min(k) OVER (PARTITION BY doc_id, idx, round(size, 1)) AS first FROM (
        SELECT doc_id, ln AS idx, k, CASE WHEN (doc_id + ln * 2 + k) % 7 = 0 THEN NULL WHEN (doc_id + k) % 5 = 0 THEN 12.04::DOUBLE ELSE 14.0::DOUBLE END AS size
        FROM (SELECT *, unnest(range(0, (greatest(length(txt), 1) - 1) // 20 + 1)) AS k FROM base_lines)) WHERE size IS NOT NULL) GROUP BY doc_id, idx""")
def _(f):
    return features.run_font_sizes(f.runs)


@query("P11_doc_body_modes", "doc_id:l non_empty:l body_size:d body_family:s body_spacing:d", """
    SELECT d.doc_id, d.non_empty, b.body_size, coalesce(fam.v, 'Times New Roman') AS body_family, coalesce(sp.v, 1.5) AS body_spacing
    FROM (SELECT doc_id, count(*) FILTER (NOT is_empty) AS non_empty FROM feat GROUP BY doc_id) d LEFT JOIN body_size b ON d.doc_id = b.doc_id
    LEFT JOIN (SELECT doc_id, arg_max(font_family, [n, -i]) AS v FROM (SELECT doc_id, font_family, count(*) AS n, min(idx) AS i FROM feat
      WHERE NOT is_empty AND length >= 120 AND bold_ratio < 0.2 AND len(ntok) = 0 GROUP BY doc_id, font_family) GROUP BY doc_id) fam ON d.doc_id = fam.doc_id
    LEFT JOIN (SELECT doc_id, arg_max(line_spacing, [n, -i]) AS v FROM (SELECT doc_id, line_spacing, count(*) AS n, min(idx) AS i FROM feat
      WHERE NOT is_empty AND length >= 120 AND bold_ratio < 0.2 AND len(ntok) = 0 GROUP BY doc_id, line_spacing) GROUP BY doc_id) sp ON d.doc_id = sp.doc_id""")
def _(f):
    return features.doc_body_modes(f.zoned)


@query("P12_numid_group_sizes", "doc_id:l numpr_num_id:l group_size:l",
       "SELECT doc_id, numpr_num_id, count(*) AS group_size FROM feat WHERE NOT is_empty AND numpr_num_id IS NOT NULL GROUP BY doc_id, numpr_num_id")
def _(f):
    return features.numid_group_sizes(f.zoned)


@query("P13_font_size_histogram", "doc_id:l size:d paragraphs:l",
       "SELECT doc_id, round(modal_font_size_pt, 1) AS size, count(*) AS paragraphs FROM feat WHERE NOT is_empty GROUP BY doc_id, round(modal_font_size_pt, 1)")
def _(f):
    return features.font_size_histogram(f.zoned)


@query("P14_native_heading_level", "doc_id:l idx:l style_name:s native:l", "SELECT doc_id, idx, style_name, native FROM feat WHERE native IS NOT NULL")
def _(f):
    return f.paragraphs.withColumn("native", tx.native_heading_level(F.col("style_name"))).where("native IS NOT NULL")


@query("P15_neighbour_features", "doc_id:l idx:l b_len:l b_tok:s b_bold:d b_per:b a_len:l a_tok:s a_bold:d a_per:b", """
    SELECT doc_id, idx, pv.len AS b_len, array_to_string(pv.tok, ',') AS b_tok, pv.bold AS b_bold, pv.per AS b_per,
      nx.len AS a_len, array_to_string(nx.tok, ',') AS a_tok, nx.bold AS a_bold, nx.per AS a_per FROM near""")
def _(f):
    rows = features.neighbour_features(f.zoned)
    out = []
    for name, p in (("before", "b"), ("after", "a")):
        out += [
            F.col(f"{name}.length").alias(f"{p}_len"), _TOKENS(f"{name}.tokens").alias(f"{p}_tok"),
            F.col(f"{name}.bold_ratio").alias(f"{p}_bold"), F.col(f"{name}.ends_with_period").alias(f"{p}_per"),
        ]
    return rows.select("doc_id", "idx", *out)


@query("P16_dense_text", "doc_id:l idx:l", "SELECT doc_id, idx FROM feat WHERE dense")
def _(f):
    rows = f.paragraphs.withColumn("stripped", tx.strip_blank(F.col("text")))
    return rows.where(tx.dense_text(F.col("stripped")))


@query("Z1_title_page_end", "doc_id:l title_end:l", "SELECT doc_id, title_end FROM titles")
def _(f):
    return zones.title_page_end(features.enrich(f.paragraphs), RULES)


def _phase(name, phase):
    @query(name, "doc_id:l idx:l", f"SELECT doc_id, idx FROM toc_lines WHERE phase = {phase}")
    def _(f):
        return zones.contents_lines(features.enrich(f.paragraphs), RULES).where(F.col("phase") == phase)


_phase("Z2_toc_entries", 1)
_phase("Z3_toc_by_repetition", 2)
_phase("Z4_toc_region", 3)


@query("Z5_references_range", "doc_id:l start:l end:l", "SELECT doc_id, start, stop AS \"end\" FROM bib_range")
def _(f):
    return f.bounds


@query("Z6_chapter_breaks", "doc_id:l idx:l chapter:l", "SELECT doc_id, idx, chapter FROM breaks")
def _(f):
    return zones.chapter_breaks(f.headings)


@query("Z7_chapter_at", "doc_id:l idx:l chapter:l", "SELECT doc_id, idx, chapter FROM chaptered")
def _(f):
    return zones.with_chapters(f.zoned.select("doc_id", "idx"), zones.chapter_breaks(f.headings))


@query("Z8_listing_code_lines", "doc_id:l idx:l", "SELECT doc_id, idx FROM code_lines")
def _(f):
    return zones.listing_code_lines(f.zoned)


@query("Z9_skip_rows", "doc_id:l idx:l in_title:b in_contents:b skip:b", "SELECT doc_id, idx, in_title, in_toc AS in_contents, skip FROM zone")
def _(f):
    return zones.mark_zones(features.enrich(f.paragraphs), RULES)
