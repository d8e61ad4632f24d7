"""Heading detection."""

from pyspark.sql import functions as F

from catalog.core import FINDING, RULES, query
from galley.operators import headings as hd
from galley.plans import reports

_SOFT = "doc_id:l type:s severity:s status:s paragraph_index:l section_title:s signals:s"


def _signals(rows):
    return rows.withColumn("signals", F.array_join("detector_signals", "|"))


@query("H1_heading_rejects", "doc_id:l idx:l reject:s", "SELECT doc_id, idx, early AS reject FROM sig1 WHERE early IS NOT NULL")
def _(f):
    rows = hd.candidates(f.features, RULES).withColumn("reject", hd.early_reject(RULES))
    return rows.where("reject IS NOT NULL")


@query("H2_heading_signals", "doc_id:l idx:l score:l level:l signals:s",
       "SELECT doc_id, idx, score, level, array_to_string(signals, '|') AS signals FROM scored WHERE reject IS NULL")
def _(f):
    rows = hd.score(f.features, RULES).where("reject IS NULL")
    return rows.withColumn("signals", F.array_join("signals", "|"))


@query("H3_heading_tiers", "tier:s reject:s paragraphs:l", "SELECT tier, coalesce(reject, '') AS reject, count(*) AS paragraphs FROM scored GROUP BY ALL")
def _(f):
    return f.scored.groupBy("tier", F.coalesce("reject", F.lit("")).alias("reject")).agg(F.count("*").alias("paragraphs"))


def _late(name, reason):
    @query(name, "doc_id:l idx:l reject:s", f"SELECT doc_id, idx, reject FROM scored WHERE reject = '{reason}'")
    def _(f):
        return f.scored.where(F.col("reject") == reason)


_late("H4_inline_enum_reject", "inline_enum")
_late("H5_list_sequence_reject", "list_sequence")


@query("H6_accept_high", "doc_id:l idx:l number:s", "SELECT doc_id, idx, number FROM scored WHERE tier = 'high'")
def _(f):
    return f.scored.where("tier = 'high'")


@query("H7_heading_confirm", _SOFT, """
    SELECT doc_id, 'heading_confirm' AS type, 'warning' AS severity, 'manual_required' AS status, idx AS paragraph_index,
      stripped AS section_title, array_to_string(signals, '|') AS signals FROM scored
    WHERE tier = 'medium' AND NOT regexp_matches(stripped, '^(содержание|оглавление)$', 'i')""")
def _(f):
    return _signals(hd.heading_confirm(f.scored))


def _saved(name, how):
    @query(name, "doc_id:l idx:l", f"SELECT doc_id, idx FROM saved WHERE how = '{how}'")
    def _(f):
        return hd.recovered(f.scored).where(F.col("how") == how)


_saved("H8_gap_fill", "gap")
_saved("H9_first_child_fill", "first_child")


@query("H10_semantic_confirm", _SOFT, """
    SELECT s.doc_id, 'heading_confirm' AS type, 'warning' AS severity, 'manual_required' AS status, s.idx AS paragraph_index,
      stripped AS section_title, array_to_string(signals, '|') AS signals FROM scored s LEFT JOIN saved v ON s.doc_id = v.doc_id AND s.idx = v.idx
    WHERE v.idx IS NULL AND tier = 'low' AND iso AND short AND NOT per AND NOT regexp_matches(stripped, '^(содержание|оглавление)$', 'i')""")
def _(f):
    return _signals(hd.semantic_confirm(f.scored))


@query("H11_dedupe_headings", "doc_id:l idx:l level:l source:s text:s title_only:s derived_number:s",
       "SELECT doc_id, idx, level, source, stripped AS text, title_only, number AS derived_number FROM heads")
def _(f):
    return hd.detect(f.scored)


@query("H12_after_heading_candidates", _SOFT, """
    SELECT doc_id, 'possible_missed_heading' AS type, 'info' AS severity, 'manual_required' AS status, idx AS paragraph_index, stripped AS section_title,
      array_to_string(list_concat(['after_heading'], support, CASE WHEN near_head AND above.bare THEN ['after_bare_chapter'] ELSE [] END), '|') AS signals
    FROM (SELECT *, coalesce(above.head AND idx - above.idx <= 11, false) AS near_head,
        coalesce(blank_head > coalesce(above.idx, -1) AND idx - blank_head <= 11, false) AS near_blank,
        list_sort(list_distinct(list_filter(list_transform(signals, lambda s: string_split(s, ':')[1]), lambda s: s IN ('native_style', 'outline_level',
          'chapter_word', 'appendix', 'structural_keyword', 'literal_number', 'numpr_ilvl', 'bold', 'bold_partial', 'centered', 'all_caps', 'font_large', 'page_break_before')))) AS support
      FROM (SELECT *, last_value(CASE WHEN solid THEN {'idx': idx, 'head': head, 'bare': bare} END IGNORE NULLS) OVER b AS above,
          last_value(CASE WHEN head AND NOT solid THEN idx END IGNORE NULLS) OVER b AS blank_head,
          first_value(CASE WHEN solid THEN {'head': head, 'len': length} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below
        FROM (SELECT s.*, h.idx IS NOT NULL AS head, coalesce(h.pk = 'chapter_word' AND h.ptitle = '', false) AS bare, NOT s.is_empty AND NOT s.skip AS solid,
            v.idx IS NOT NULL AS was_saved
          FROM scored s LEFT JOIN heads h ON s.doc_id = h.doc_id AND s.idx = h.idx LEFT JOIN saved v ON s.doc_id = v.doc_id AND s.idx = v.idx)
        WINDOW b AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
    WHERE solid AND NOT head AND (near_head OR near_blank) AND NOT in_table AND length <= 100 AND word_count <= 14 AND NOT regexp_matches(stripped, '[.!?:]$')
      AND NOT regexp_matches(stripped, '^(?:рисунок|рис\\.|таблица|табл\\.|листинг)\\s+\\d+(?:\\.\\d+)*(?:\\s*[:–—-]\\s*|\\.\\s+)\\S', 'i')
      AND NOT regexp_matches(stripped, '^(содержание|оглавление)$', 'i') AND regexp_matches(stripped, '^\\p{Lu}')
      AND NOT (numpr_num_id IS NOT NULL AND numpr_ilvl IS NOT NULL) AND coalesce(below.head OR below.len >= 60, false)
      AND (len(support) > 0 OR (near_head AND above.bare)) AND NOT was_saved AND tier <> 'medium' AND NOT (tier = 'low' AND iso AND short AND NOT per)""")
def _(f):
    return _signals(hd.missed_headings(f.scored, f.headings))


_SEQUENCE = """
    SELECT *, CASE WHEN nl = 1 THEN CAST(c1 + 1 AS VARCHAR) WHEN nl = 2 THEN concat(c1, '.', c2 + 1) ELSE concat(c1, '.', c2, '.', c3 + 1) END AS expected,
      CASE WHEN ol = 1 THEN CAST(c1 + 1 AS VARCHAR) WHEN ol = 2 THEN concat(c1, '.', c2 + 1) WHEN ol = 3 THEN concat(c1, '.', c2, '.', c3 + 1) END AS other
    FROM (SELECT *, CASE WHEN lv >= 2 AND c1 = 0 THEN 1 WHEN lv >= 3 AND c2 = 0 THEN 2 ELSE least(lv, 3) END AS nl,
        CASE WHEN lv > 1 THEN CASE WHEN lv - 1 >= 2 AND c1 = 0 THEN 1 WHEN lv - 1 >= 3 AND c2 = 0 THEN 2 ELSE least(lv - 1, 3) END WHEN c1 > 0 THEN 2 END AS ol
      FROM (SELECT *, coalesce(bt[1], 0) AS c1, coalesce(bt[2], 0) AS c2, coalesce(bt[3], 0) AS c3 FROM (
        SELECT *, lag(list_transform(string_split(raw, '.'), lambda t: CAST(t AS BIGINT))) OVER (PARTITION BY doc_id ORDER BY idx) AS bt FROM (
          SELECT doc_id, idx, stripped AS text, title_only, coalesce(pnum, number) AS raw, coalesce(plevel, len(string_split(number, '.'))) AS lv
          FROM heads WHERE pk IS NOT NULL OR regexp_matches(number, '^\\d+(\\.\\d+)*$')))))"""


@query("H13_heading_number_conflict", FINDING + " options:s description:s", f"""
    SELECT doc_id, 'heading_number_conflict' AS type, 'warning' AS severity, 'manual_required' AS status, idx AS paragraph_index, raw AS original_text,
      array_to_string(list_filter([raw, expected, CASE WHEN other NOT IN (raw, expected) THEN other END], lambda o: o IS NOT NULL), '|') AS options,
      concat('«', coalesce(nullif(title_only, ''), text), '»: в тексте стоит «', raw, '», по последовательности должно быть «', expected, '».',
        CASE WHEN other <> expected THEN concat(' Или выберите «', other, '» (уровень выше/ниже).') ELSE '' END) AS description
    FROM ({_SEQUENCE}) WHERE raw <> expected""")
def _(f):
    return hd.heading_number_conflict(f.headings).withColumn("options", F.array_join("fix_options", "|"))


@query("H14_cascade_root", "doc_id:l idx:l caused_by:l", f"""
    SELECT doc_id, idx, CASE WHEN idx > root THEN root END AS caused_by FROM (
      SELECT *, min(CASE WHEN bad THEN idx END) OVER (PARTITION BY doc_id, island) AS root FROM (
        SELECT *, count(*) FILTER (NOT bad) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT doc_id, idx, raw <> expected AS bad FROM ({_SEQUENCE})))) WHERE bad""")
def _(f):
    return hd.with_cascade_root(hd.number_sequence(f.headings)).where("conflict")


@query("H15_heading_decisions", "doc_id:l idx:l status:s tier_display:s score:l level:l text:s", """
    SELECT s.doc_id, s.idx, CASE WHEN reject IS NOT NULL THEN 'rejected' WHEN v.idx IS NOT NULL THEN 'recovered' ELSE tier END AS status,
      CASE WHEN reject IS NOT NULL THEN concat('REJECT(', reject, ')') WHEN v.idx IS NOT NULL THEN concat('RECOV(', score, ')')
        ELSE concat(upper(tier), '(', score, ')', CASE WHEN h.idx IS NULL AND tier <> 'none' THEN '-soft' ELSE '' END) END AS tier_display,
      score, CASE WHEN reject IS NULL THEN level END AS level, stripped AS text
    FROM scored s LEFT JOIN saved v ON s.doc_id = v.doc_id AND s.idx = v.idx
      LEFT JOIN (SELECT doc_id, idx FROM heads) h ON s.doc_id = h.doc_id AND s.idx = h.idx""")
def _(f):
    return hd.decisions(f.scored, f.headings)


@query("H16_heading_apply_guard", "doc_id:l idx:l", "SELECT doc_id, idx FROM heads WHERE NOT in_table AND length > 0")
def _(f):
    return hd.may_apply(f.headings)


@query("H0_heading_recovered", FINDING, """
    SELECT s.doc_id, 'heading_recovered' AS type, 'info' AS severity, 'auto_fixed' AS status, s.idx AS paragraph_index, stripped AS original_text
    FROM scored s JOIN saved v ON s.doc_id = v.doc_id AND s.idx = v.idx""")
def _(f):
    return hd.heading_recovered(f.scored)


@query("W31_recheck_headings", FINDING)
def _(f):
    return reports.recheck_headings(f.paragraphs, RULES)
