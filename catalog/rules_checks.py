"""Structure, citations, sources, captions, appendices, formulas, layout and tables."""

from pyspark.sql import functions as F

from catalog.core import FINDING, RULES, query
from galley.operators import appendix, bibliography, captions, citations, formulas, layout, structure, tables
from oracle.base import REF, strip

_FIXED = FINDING + " fixed_text:s"


def _finding(type_, severity, status, at, original, tail):
    return (
        f"SELECT doc_id, '{type_}' AS type, '{severity}' AS severity, '{status}' AS status, {at} AS paragraph_index, "
        f"{original} AS original_text {tail}"
    )


@query("F1_forbidden_heading", _FIXED, """
    SELECT doc_id, 'forbidden_heading' AS type, 'critical' AS severity, CASE WHEN replacement IS NULL THEN 'manual_required' ELSE 'auto_fixed' END AS status,
      idx AS paragraph_index, stripped AS original_text, replacement AS fixed_text FROM head_title JOIN forbidden_names ON title_norm = key_norm""")
def _(f):
    return structure.forbidden_heading(f.headings, RULES)


_RENAMES = """SELECT alias, canonical FROM section_names WHERE NOT is_canonical AND section IN ('contents', 'introduction', 'conclusion', 'references', 'terms')
    AND alias NOT IN (SELECT key_norm FROM forbidden_names)"""


@query("F2_heading_rename", _FIXED, f"""
    SELECT doc_id, 'heading_rename' AS type, 'warning' AS severity, 'auto_fixed' AS status, idx AS paragraph_index, stripped AS original_text,
      canonical AS fixed_text FROM head_title JOIN ({_RENAMES}) ON title_norm = alias""")
def _(f):
    return structure.heading_rename(f.headings, RULES)


@query("F3_apply_title_fixes", "doc_id:l idx:l text:s", f"""
    SELECT p.doc_id, p.idx, coalesce(n.replacement, p.text) AS text FROM paras p LEFT JOIN (
      SELECT doc_id, idx, replacement FROM head_title JOIN forbidden_names ON title_norm = key_norm WHERE replacement IS NOT NULL
      UNION ALL SELECT doc_id, idx, canonical FROM head_title JOIN ({_RENAMES}) ON title_norm = alias) n ON p.doc_id = n.doc_id AND p.idx = n.idx""")
def _(f):
    return structure.apply_text(f.paragraphs.select("doc_id", "idx", "text"), structure.title_fixes(f.headings, RULES))


_TAIL = r"(?:\t+|\s{2,}|\.{2,}[.\s]*)\s*\d{1,4}\s*$"


@query("F4_structural_heading_malformed", _FIXED, f"""
    SELECT DISTINCT doc_id, 'structural_heading_malformed' AS type, 'warning' AS severity, 'auto_fixed' AS status, idx AS paragraph_index,
      stripped AS original_text, cleaned AS fixed_text FROM (
      SELECT *, {strip(f"regexp_replace(stripped, '{_TAIL}', '')")} AS cleaned FROM zone WHERE NOT skip AND NOT is_empty AND regexp_matches(stripped, '{_TAIL}'))
    JOIN section_names ON lower(trim(regexp_replace(cleaned, '\\s+', ' ', 'g'))) = alias""")
def _(f):
    return structure.structural_heading_malformed(structure.malformed_headings(f.zoned, RULES), True)


def _positions(f):
    return f._written("sections", lambda: structure.section_positions(f.features, f.headings, f.hidden_texts, RULES, f.marks))


_WIDE = """SELECT d.doc_id, max(pos) FILTER (section = 'contents') AS c, max(pos) FILTER (section = 'introduction') AS i,
    max(pos) FILTER (section = 'conclusion') AS e, max(pos) FILTER (section = 'references') AS r, max(pos) FILTER (section = 'terms') AS t
    FROM documents d LEFT JOIN spots s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


@query("F5_missing_section", "doc_id:l severity:s description:s", f"""
    SELECT doc_id, 'critical' AS severity, concat('Отсутствует обязательный раздел «', name, '».') AS description FROM (
      SELECT doc_id, unnest([CASE WHEN c IS NULL THEN 'Содержание' END, CASE WHEN i IS NULL THEN 'Введение' END, CASE WHEN e IS NULL THEN 'Заключение' END]) AS name
      FROM ({_WIDE})) WHERE name IS NOT NULL""")
def _(f):
    return structure.missing_section(f.docs, _positions(f))


@query("F6_section_order", "doc_id:l severity:s description:s", """
    SELECT doc_id, 'critical' AS severity, concat('Нарушен порядок разделов: «', name, '» должен располагаться до «', nname, '».') AS description FROM (
      SELECT *, lead(pos) OVER w AS npos, lead(name) OVER w AS nname FROM (
        SELECT doc_id, pos, CASE section WHEN 'contents' THEN 1 WHEN 'introduction' THEN 2 WHEN 'conclusion' THEN 3 ELSE 4 END AS k,
          CASE section WHEN 'contents' THEN 'Содержание' WHEN 'introduction' THEN 'Введение' WHEN 'conclusion' THEN 'Заключение'
            ELSE 'Список использованных источников' END AS name FROM spots WHERE section <> 'terms')
      WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE pos >= npos""")
def _(f):
    return structure.section_order(f.docs, _positions(f))


@query("F7_optional_before_intro", "doc_id:l severity:s type:s", f"""
    SELECT doc_id, 'warning' AS severity, 'structural_order_violation' AS type FROM ({_WIDE}) WHERE t >= i""")
def _(f):
    return structure.optional_before_intro(f.docs, _positions(f))


@query("C1_citations", "doc_id:l idx:l token_no:l raw_token:s part_no:l n_pos:l n:l", "SELECT doc_id, idx, token_no, raw_token, part_no, n_pos, n FROM cited")
def _(f):
    return citations.citations(f.zoned, f.bounds)


@query("C2_citation_sequence", "doc_id:l description:s", """
    SELECT doc_id, concat('Ссылки в тексте встречаются не в порядке возрастания. Порядок первых появлений: [',
      array_to_string(list(n ORDER BY rk) FILTER (rk <= 15), ', '), ']...') AS description FROM (
      SELECT *, lag(n) OVER w AS before, row_number() OVER w AS rk FROM first_cited WINDOW w AS (PARTITION BY doc_id ORDER BY idx, token_no, part_no, n_pos))
    GROUP BY doc_id HAVING count(*) > 1 AND count(*) FILTER (before > n) / (count(*) - 1) >= 0.3""")
def _(f):
    return citations.citation_sequence(f.mentions)


_IN = r"\d+(?:\s*[,\-‒–—−]\s*\d+)*"


@query("C3_citation_separator_missing", FINDING, _finding("citation_separator_missing", "info", "auto_fixed", "idx", "NULL",
       f"FROM zone WHERE NOT skip AND NOT is_empty AND regexp_matches(stripped, '\\[{_IN}\\]\\s*\\[{_IN}\\]')"))
def _(f):
    return citations.citation_separators(f.zoned)


@query("C4_citation_combined", FINDING, _finding("citation_combined", "info", "auto_fixed", "idx", "NULL",
       r"FROM zone WHERE NOT skip AND NOT is_empty AND regexp_matches(stripped, '\[\d+(\s*,\s*\d+)+\]')"))
def _(f):
    return citations.citation_combined(f.zoned)


@query("C5_citation_range_suspicious", FINDING, f"""
    SELECT doc_id, 'citation_range_suspicious' AS type, 'warning' AS severity, 'manual_required' AS status, idx AS paragraph_index, concat('[', lo, '-', hi, ']') AS original_text
    FROM (SELECT doc_id, idx, CAST(regexp_extract(pair, '^(\\d+)', 1) AS BIGINT) AS lo, CAST(regexp_extract(pair, '(\\d+)$', 1) AS BIGINT) AS hi FROM (
      SELECT doc_id, idx, unnest(regexp_extract_all(token, '\\d+\\s*[\\-‒–—−]\\s*\\d+')) AS pair FROM (
        SELECT doc_id, idx, unnest(regexp_extract_all(stripped, '\\[{_IN}\\]')) AS token FROM zone WHERE NOT skip AND NOT is_empty))) WHERE hi - lo > 20""")
def _(f):
    return citations.citation_range_suspicious(f.zoned)


@query("C6_fix_separators", "doc_id:l idx:l text:s", f"""
    SELECT doc_id, idx, regexp_replace(regexp_replace(text, '(\\[{_IN}\\])\\s*(\\[{_IN}\\])', '\\1, \\2', 'g'), '(\\[{_IN}\\])\\s*(\\[{_IN}\\])', '\\1, \\2', 'g') AS text FROM paras""")
def _(f):
    return f.paragraphs.withColumn("text", citations.fix_separators(F.col("text")))


@query("C7_fix_combined", "doc_id:l idx:l text:s", """
    SELECT doc_id, idx, array_to_string(list_transform(list_zip(regexp_split_to_array(text, '\\[\\d+(?:\\s*,\\s*\\d+)+\\]'),
        regexp_extract_all(text, '\\[\\d+(?:\\s*,\\s*\\d+)+\\]')),
      lambda z: concat(z[1], CASE WHEN z[2] IS NOT NULL THEN regexp_replace(z[2], '\\s*,\\s*', '], [', 'g') ELSE '' END)), '') AS text FROM paras""")
def _(f):
    return f.paragraphs.withColumn("text", citations.fix_combined(F.col("text")))


@query("B1_bib_entries", "doc_id:l idx:l number:l body:s", "SELECT doc_id, idx, number, body FROM entries")
def _(f):
    return bibliography.bib_entries(f.listed)


@query("B2_bib_malformed", FINDING, _finding("bibliography_entry_malformed", "warning", "manual_required", "idx", "stripped",
       r"FROM listed WHERE numpr_num_id IS NULL AND NOT regexp_matches(stripped, '^\d+[.)]\s+') AND regexp_matches(stripped, '^\s*\d+\s*(?:[-–—]\s*\d+|[.,]\d)')"))
def _(f):
    return bibliography.bib_malformed(f.listed)


@query("B3_bib_numbering_gap", FINDING, _finding("bibliography_numbering_gap", "warning", "manual_required", "idx", "body",
       "FROM (SELECT *, coalesce(lag(number) OVER (PARTITION BY doc_id ORDER BY idx), 0) + 1 AS want FROM entries) WHERE number <> want"))
def _(f):
    return bibliography.bib_numbering_gap(f.entries)


@query("B4_citation_without_source", FINDING, _finding("citation_without_source", "critical", "manual_required", "idx", "raw_token",
       """FROM first_cited c WHERE c.doc_id IN (SELECT doc_id FROM entries)
          AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.doc_id = c.doc_id AND e.number = c.n)"""))
def _(f):
    return bibliography.citation_without_source(f.mentions, f.entries)


@query("B5_source_not_cited", "doc_id:l description:s", """
    SELECT DISTINCT e.doc_id, concat('Источник ', number, ' присутствует в списке, но не цитируется в тексте.') AS description FROM entries e
    WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.doc_id = e.doc_id AND c.n = e.number)""")
def _(f):
    return bibliography.source_not_cited(f.ranges, f.entries)


@query("B6_bib_incomplete", FINDING, _finding("bibliography_entry_incomplete", "warning", "manual_required", "idx", "body",
       r"""FROM entries WHERE (length(body) < 20 OR NOT regexp_matches(body, '(^|[^\p{L}\p{N}_])(19|20)\d{2}([^\p{L}\p{N}_]|$)'))
       AND NOT regexp_matches(body, 'https?://|www\.', 'i')
       AND NOT regexp_matches(body, '(^|[^\p{L}\p{N}_])(гост|iso|rfc|снип|фз|приказ|ост|сп\s+\d)([^\p{L}\p{N}_]|$)', 'i')"""))
def _(f):
    return bibliography.bib_incomplete(f.entries)


@query("B7_bib_missing", FINDING, """
    SELECT d.doc_id, CASE WHEN b.doc_id IS NULL THEN 'bibliography_missing' ELSE 'bibliography_entries_unrecognised' END AS type,
      CASE WHEN b.doc_id IS NULL THEN 'critical' ELSE 'warning' END AS severity, 'manual_required' AS status, NULL AS paragraph_index, NULL AS original_text
    FROM documents d LEFT JOIN bib_range b ON d.doc_id = b.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM entries)""")
def _(f):
    return bibliography.bib_missing(f.docs, f.bounds, f.entries)


_AUTO = r"""
    SELECT doc_id, idx, seed + moved - coalesce(seed_moved, 0) AS number, stripped, needs FROM (
      SELECT *, coalesce(last_value(ex IGNORE NULLS) OVER w, 0) AS seed, last_value(CASE WHEN ex IS NOT NULL THEN moved END IGNORE NULLS) OVER w AS seed_moved FROM (
        SELECT *, count(*) FILTER (ex IS NULL AND (numpr_num_id IS NOT NULL OR needs)) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS moved FROM (
          SELECT *, ex IS NULL AND numpr_num_id IS NULL AND regexp_matches(stripped, '^[«"“„(]?[A-ZА-ЯЁ]') AND NOT regexp_matches(stripped, '^[IVXLCDMivxlcdm]+[.)]\s+\S') AS needs
          FROM (SELECT *, TRY_CAST(nullif(regexp_extract(stripped, '^(\d+)[.)]\s+', 1), '') AS BIGINT) AS ex FROM listed)))
      WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)) WHERE needs"""


@query("B8_autonumber_bib", "doc_id:l idx:l number:l new_text:s", f"SELECT doc_id, idx, number, concat(number, '. ', stripped) AS new_text FROM ({_AUTO})")
def _(f):
    return bibliography.autonumber(f.listed)


@query("B9_bib_autonumbered_notice", "doc_id:l status:s description:s", f"""
    SELECT doc_id, 'auto_fixed' AS status, concat('Автоматически пронумерованы источники без номера: ', count(*), '.') AS description FROM ({_AUTO}) GROUP BY doc_id""")
def _(f):
    return bibliography.autonumbered_notice(bibliography.autonumber(f.listed))


def _caption_query(name, kind):
    @query(name, "doc_id:l idx:l original_number:s title:s text:s", f"SELECT doc_id, idx, original_number, title, text FROM caps_raw WHERE kind = '{kind}'")
    def _(f):
        return captions.caption_rows(f.features, kind, marks=f.marks)


_caption_query("K1_figure_captions", "figure")
_caption_query("K2_table_captions", "table")
_caption_query("K3_listing_captions", "listing")


@query("K4_number_by_chapter", "doc_id:l idx:l kind:s new_number:s", "SELECT doc_id, idx, kind, new_number FROM caps WHERE kind <> 'listing'")
def _(f):
    return captions.all_captions(f.features, f.headings, RULES, marks=f.marks)


@query("K5_number_in_appendix", "doc_id:l idx:l kind:s new_number:s", "SELECT doc_id, idx, kind, new_number FROM caps WHERE kind = 'listing'")
def _(f):
    return f.caps.where("kind = 'listing'")


@query("K6_caption_renumbered", _FIXED, """
    SELECT doc_id, 'caption_renumbered' AS type, 'info' AS severity, 'manual_required' AS status, idx AS paragraph_index, text AS original_text,
      concat(CASE kind WHEN 'figure' THEN 'Рисунок' WHEN 'table' THEN 'Таблица' ELSE 'Листинг' END, ' ', new_number, ' — ', title) AS fixed_text
    FROM caps WHERE coalesce(original_number, '') <> new_number""")
def _(f):
    return captions.caption_renumbered(f.caps)


def _shown(f):
    return f.shown


@query("K7_reference_spans", "doc_id:l idx:l span_no:l num_no:l kind:s num:s phrase:s", "SELECT doc_id, idx, span_no, num_no, kind, num, phrase FROM refs")
def _(f):
    return captions.text_references(f.features, _shown(f), f.marks)


def _resolved(f):
    return f._written("resolved", lambda: captions.resolve_references(captions.text_references(f.features, _shown(f), f.marks), _shown(f)))


@query("K8_resolve_refs", "doc_id:l kind:s resolved:s idx:l phrase:s", "SELECT doc_id, kind, resolved, idx, phrase FROM resolved")
def _(f):
    return captions.resolve_references(captions.text_references(f.features, _shown(f), f.marks), _shown(f))


@query("K9_not_referenced", FINDING, """
    SELECT doc_id, concat(kind, '_not_referenced') AS type, 'info' AS severity, 'manual_required' AS status, idx AS paragraph_index,
      concat(CASE kind WHEN 'figure' THEN 'Рисунок ' ELSE 'Таблица ' END, new_number, ' — ', title) AS original_text FROM caps c
    WHERE kind <> 'listing' AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.doc_id = c.doc_id AND r.kind = c.kind AND r.resolved = c.new_number)""")
def _(f):
    return captions.not_referenced(_shown(f), _resolved(f))


@query("K10_dangling_refs", FINDING, """
    SELECT doc_id, concat(kind, '_reference_missing') AS type, CASE kind WHEN 'figure' THEN 'warning' ELSE 'info' END AS severity, 'manual_required' AS status,
      idx AS paragraph_index, phrase AS original_text FROM resolved r
    WHERE NOT EXISTS (SELECT 1 FROM valid v WHERE v.doc_id = r.doc_id AND v.kind = r.kind AND v.new_number = r.resolved)""")
def _(f):
    return captions.dangling_references(_shown(f), _resolved(f))


_PIECES = f"""
    SELECT doc_id, idx, span, k, piece, CASE WHEN regexp_matches(piece, '^\\d') THEN kind END AS kind FROM (
      SELECT doc_id, idx, span, kind, unnest(list_concat([before, lead], parts)) AS piece, unnest(range(len(parts) + 2)) AS k FROM (
        SELECT doc_id, idx, span, before, CASE WHEN phrase IS NULL THEN '' ELSE regexp_extract(phrase, '^[^0-9]*') END AS lead,
          CASE WHEN starts_with(lower(phrase), 'рис') THEN 'figure' ELSE 'table' END AS kind,
          CASE WHEN phrase IS NULL THEN [] ELSE regexp_extract_all(regexp_extract(phrase, '[0-9].*$'), '\\d+(?:\\.\\d+)*|[^0-9]+') END AS parts FROM (
          SELECT doc_id, idx, unnest(range(len(z))) AS span, unnest(z)[1] AS before, unnest(z)[2] AS phrase FROM (
            SELECT doc_id, idx, list_zip(regexp_split_to_array(text, '(?i){REF.replace("(рис", "(?:рис", 1).replace("([№", "(?:[№", 1).replace(")(" + chr(92) + "d+", ")(?:" + chr(92) + "d+", 1)}'), regexp_extract_all(text, '{REF}', 0, 'i')) AS z FROM zone p
            WHERE NOT in_title AND regexp_matches(text, '{REF}', 'i')
              AND NOT EXISTS (SELECT 1 FROM caps c WHERE c.doc_id = p.doc_id AND c.idx = p.idx AND c.kind <> 'listing')))))"""


@query("K11_rewrite_refs", "doc_id:l idx:l new_text:s", f"""
    SELECT p.doc_id, p.idx, string_agg(coalesce(m.mapped, v.new_number, w.new_number, p.piece), '' ORDER BY p.span, p.k) AS new_text FROM ({_PIECES}) p
    LEFT JOIN num_map m ON p.doc_id = m.doc_id AND p.kind = m.kind AND p.piece = m.num
    LEFT JOIN valid v ON p.doc_id = v.doc_id AND p.kind = v.kind AND p.piece = v.new_number
    LEFT JOIN valid w ON p.doc_id = w.doc_id AND p.kind = w.kind AND NOT contains(p.piece, '.') AND CAST(TRY_CAST(p.piece AS BIGINT) AS VARCHAR) = w.new_number
    GROUP BY p.doc_id, p.idx""")
def _(f):
    return captions.rewrite_references(f.zoned.where("NOT in_title"), _shown(f))[0]


_ELEMENTS = """SELECT doc_id, elem_no, 'p' AS kind, text, idx, NULL AS tbl_no, NULL AS cell_caption FROM paras UNION ALL
    SELECT doc_id, elem_no + 1, 'tbl', NULL, NULL, CAST(floor((pos - 1) / 10) AS INT), CASE WHEN doc_id % 6 = 4 THEN 'Таблица 1 — Итоги' END FROM paras WHERE table_follows"""
_CAPLINE = r"^(таблица|табл\.)\s+\d+(?:\.\d+)*(?:\s*[:–—-]\s*|\.\s+)\S"


ABOVE = f"""
    WITH e AS (SELECT *, kind = 'p' AND regexp_matches(coalesce(text, ''), '{_CAPLINE}', 'i') AS cap, kind = 'tbl' OR trim(text) <> '' AS solid FROM ({_ELEMENTS})),
    n AS (SELECT *, last_value(CASE WHEN solid THEN {{'no': elem_no, 'cap': cap, 'kind': kind}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY elem_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up,
      first_value(CASE WHEN solid THEN {{'no': elem_no, 'cap': cap}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY elem_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS down FROM e),
    t AS (SELECT *, kind = 'tbl' AND NOT coalesce(up.cap, false) AS free, kind = 'tbl' AND NOT coalesce(up.cap, false) AND coalesce(down.cap, false) AS takes FROM n),
    m AS (SELECT t.*, o.elem_no AS owner FROM t LEFT JOIN t o ON o.takes AND t.cap AND o.doc_id = t.doc_id AND o.elem_no = t.up.no)
    SELECT doc_id, elem_no, kind, text, CASE WHEN owner IS NOT NULL THEN owner * 2 - 1 ELSE elem_no * 2 END AS new_pos, owner IS NOT NULL AS moved FROM m
    UNION ALL SELECT doc_id, elem_no, 'p', cell_caption, elem_no * 2 - 1, true FROM m WHERE free AND NOT takes AND cell_caption IS NOT NULL"""


@query("K12_caption_above_table", "doc_id:l elem_no:l kind:s text:s new_pos:l moved:b", ABOVE)
def _(f):
    return captions.move_captions_above(f.body_elements)


@query("K13_caption_table_pairs", "doc_id:l tbl_no:l caption_idx:l number:s title:s", """
    SELECT p.doc_id, CAST(floor((p.pos - 1) / 10) AS INT) AS tbl_no, c.idx AS caption_idx, c.new_number AS number, c.title FROM paras p
    JOIN (SELECT doc_id, idx, max(idx) FILTER (trim(text) <> '') OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS last_solid,
        max(CASE WHEN table_follows THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_table FROM paras) l
      ON p.doc_id = l.doc_id AND p.idx = l.idx AND (l.last_table IS NULL OR l.last_solid > l.last_table)
    JOIN caps c ON c.doc_id = p.doc_id AND c.idx = l.last_solid AND c.kind = 'table' WHERE p.table_follows""")
def _(f):
    return captions.caption_table_pairs(f.body_elements, f.caps.where("kind = 'table'"))


def _letters(f):
    return f._written("letters", lambda: appendix.appendix_letters(f.headings))


def _mentions(f):
    return f._written("mentions", lambda: appendix.appendix_mentions(f.zoned, _letters(f)))


@query("A1_appendix_letters", "doc_id:l idx:l letter:s place:l", "SELECT doc_id, idx, letter, place FROM appendices")
def _(f):
    return appendix.appendix_letters(f.headings)


@query("A2_appendix_letter_invalid", "doc_id:l type:s paragraph_index:l", "SELECT doc_id, 'appendix_letter_invalid' AS type, idx AS paragraph_index FROM appendices WHERE place IS NULL")
def _(f):
    return appendix.appendix_letter_invalid(_letters(f))


@query("A3_appendix_letter_gap", "doc_id:l type:s paragraph_index:l description:s", """
    SELECT doc_id, 'appendix_letter_gap' AS type, idx AS paragraph_index, CASE WHEN rn > 1 THEN concat('«Приложение ', letter, '»: буква «', letter, '» уже использована ранее.')
      ELSE concat('«Приложение ', letter, '»: ожидалось «Приложение ', substr('АБВГДЕЖИКЛМНПРСТУФХЦШЩЭЮЯ', want + 1, 1), '» — нарушена последовательность обозначений приложений.') END AS description
    FROM (SELECT *, coalesce(lag(place) OVER (PARTITION BY doc_id, rn > 1 ORDER BY idx), -1) + 1 AS want FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, letter ORDER BY idx) AS rn FROM appendices WHERE place IS NOT NULL)) WHERE rn > 1 OR place <> want""")
def _(f):
    return appendix.appendix_letter_gap(_letters(f))


@query("A4_appendix_not_referenced", "doc_id:l type:s paragraph_index:l description:s", """
    SELECT doc_id, 'appendix_not_referenced' AS type, idx AS paragraph_index, concat('Приложение «', letter, '» не упомянуто в тексте ВКР.') AS description FROM appendices a
    WHERE place IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mentions m WHERE m.doc_id = a.doc_id AND m.letter = a.letter)""")
def _(f):
    return appendix.appendix_not_referenced(_letters(f), _mentions(f))


@query("A5_appendix_order", "doc_id:l type:s paragraph_index:l", """
    SELECT doc_id, 'appendix_order_violation' AS type, nfirst AS paragraph_index FROM (
      SELECT a.doc_id, first_ref, lead(first_ref) OVER w AS nref, lead(first_idx) OVER w AS nfirst FROM (
        SELECT *, min(idx) OVER (PARTITION BY doc_id, letter) AS first_idx FROM appendices WHERE place IS NOT NULL) a
      JOIN mentions m ON a.doc_id = m.doc_id AND a.letter = m.letter WINDOW w AS (PARTITION BY a.doc_id ORDER BY a.idx)) WHERE first_ref > nref""")
def _(f):
    return appendix.appendix_order(_letters(f), _mentions(f))


def _equations(f):
    return f._written("equations", lambda: formulas.formulas(f.features, f.headings, f.marks))


@query("M1_formulas", "doc_id:l idx:l number:s text:s has_tab:b explained:b", "SELECT doc_id, idx, number, text, has_tab, explained FROM equations")
def _(f):
    return formulas.formulas(f.features, f.headings, f.marks)


@query("M2_formula_number_not_right", FINDING, _finding("formula_number_not_right", "warning", "auto_fixed", "idx", "text",
       "FROM equations WHERE number IS NOT NULL AND NOT has_tab"))
def _(f):
    return formulas.formula_number_not_right(_equations(f))


@query("M3_formula_without_explanation", FINDING, _finding("formula_without_explanation", "warning", "manual_required", "idx", "text", "FROM equations WHERE NOT explained"))
def _(f):
    return formulas.formula_without_explanation(_equations(f))


@query("M4_formula_numbering_gap", FINDING + " description:s", """
    SELECT doc_id, 'formula_numbering_gap' AS type, 'warning' AS severity, 'manual_required' AS status, idx AS paragraph_index, text AS original_text,
      concat('Нарушена сквозная нумерация формул: ожидалась (', want, '), найдена (', n, ').') AS description FROM (
      SELECT *, coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY idx), 0) + 1 AS want FROM (
        SELECT *, CAST(number AS BIGINT) AS n FROM equations WHERE regexp_matches(number, '^\\d+$'))) WHERE n <> want""")
def _(f):
    return formulas.formula_numbering_gap(_equations(f))


@query("M5_fix_formula_alignment", "doc_id:l idx:l new_text:s", """
    SELECT doc_id, idx, concat(regexp_replace(text, '\\s*\\(\\d+(\\.\\d+)?\\)\\s*$', ''), chr(9), '(', number, ')') AS new_text
    FROM equations WHERE number IS NOT NULL AND NOT has_tab""")
def _(f):
    return formulas.fix_alignment(_equations(f))


_PAGES = """SELECT doc_id, chars, greatest(1, round_even(chars / 1800, 0)) AS pages FROM (
    SELECT doc_id, sum(CASE WHEN in_title THEN 0 ELSE length END) AS chars FROM zone GROUP BY doc_id)"""


@query("V1_estimate_pages", "doc_id:l chars:l pages:l", _PAGES)
def _(f):
    return layout.estimate_pages(f.zoned)


@query("V2_volume_limits", "doc_id:l type:s description:s", f"""
    SELECT doc_id, CASE WHEN pages < 40 THEN 'volume_below_minimum' ELSE 'volume_above_maximum' END AS type,
      concat('Оценочный объём бакалаврской работы (', CAST(pages AS BIGINT), CASE WHEN pages < 40 THEN ' стр.) ниже минимального (40).' ELSE ' стр.) превышает максимум (120).' END) AS description
    FROM ({_PAGES}) WHERE pages < 40 OR pages > 120""")
def _(f):
    return layout.volume_limits(layout.estimate_pages(f.zoned), RULES)


@query("V3_font_size_inconsistency", "doc_id:l status:s description:s", """
    SELECT doc_id, 'auto_fixed' AS status, concat('В документе встречаются разные размеры шрифта. Распределение по абзацам: ',
      string_agg(concat(CAST(size AS VARCHAR), 'pt — ', n, ' абзац. (', CAST(floor(n * 100 / total) AS BIGINT), '%)'), '; ' ORDER BY n DESC, first), '.') AS description
    FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, round(modal_font_size_pt, 1) AS size, count(*) AS n, min(idx) AS first FROM zone
      WHERE NOT in_title AND NOT is_empty GROUP BY doc_id, round(modal_font_size_pt, 1))) GROUP BY doc_id HAVING bool_or(abs(size - 14) > 0.1)""")
def _(f):
    return layout.font_size_inconsistency(f.zoned, RULES)


_EXEMPT = r"""(regexp_matches(stripped, '^(?:продолжение|окончание)\s+таблицы\s+\d+(?:\.\d+)*([^\p{L}\p{N}_]|$)', 'i') OR CASE
    WHEN regexp_matches(stripped, '^(?:таблица|табл\.)\s+\d+(?:\.\d+)*(?:\s*[:–—-]\s*|\.\s+)\S', 'i') THEN next_is_table
    ELSE regexp_matches(stripped, '^(?:рисунок|рис\.|листинг)\s+\d+(?:\.\d+)*(?:\s*[:–—-]\s*|\.\s+)\S|^формула\s+\(?\d+(?:\.\d+)?\)?([^\p{L}\p{N}_]|$)', 'i') END)"""


@query("V4_paragraph_spacing", "doc_id:l type:s description:s", f"""
    SELECT doc_id, 'paragraph_spacing' AS type, concat('Форматирование абзацев основного текста отличается от правил (затронуто абзацев: ', count(*),
      '). Выравнивание, абзацный отступ и интервалы приведены к настройкам.') AS description FROM zone z
    WHERE NOT skip AND NOT in_table AND NOT is_empty AND (abs(space_after_pt) > 0.1 OR abs(first_line_indent_cm - 1.25) > 0.05 OR alignment <> 'justify')
      AND NOT {_EXEMPT} AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = z.doc_id AND h.idx = z.idx) GROUP BY doc_id""")
def _(f):
    return layout.paragraph_spacing(f.zoned, f.headings, RULES)


def _rows(f):
    return f.rows_of_tables


@query("T1_numeric_columns", "doc_id:l tbl_no:l col_no:l filled:l numeric:l right_aligned:b", """
    SELECT doc_id, tbl_no, col_no, count(*) AS filled, count(*) FILTER (num) AS numeric, avg(CAST(num AS INT)) >= 0.7 AS right_aligned FROM (
      SELECT *, regexp_matches(trim(text), '^[+\\-±]?\\s*\\d[\\d\\s.,]*[%°]?\\s*$') AS num FROM table_cells WHERE row_no > 0 AND trim(text) <> '') GROUP BY doc_id, tbl_no, col_no""")
def _(f):
    from galley.fixtures import table_cells
    return tables.numeric_columns(table_cells(_rows(f)))


_BOLD = "SELECT doc_id, tbl_no, sum(bold_runs) AS b, sum(total_runs) AS t, max(row_no) + 1 AS n FROM table_rows GROUP BY doc_id, tbl_no"


@query("T2_table_mass_bold", "doc_id:l type:s paragraph_index:l section_title:s", f"""
    SELECT doc_id, 'table_mass_bold_removed' AS type, caption_idx AS paragraph_index, concat('Таблица ', number, ' – ', title) AS section_title
    FROM ({_BOLD}) JOIN table_pairs USING (doc_id, tbl_no) WHERE b / t >= 0.6""")
def _(f):
    return tables.table_mass_bold_removed(_rows(f), f.table_pairs)


@query("T3_long_table", "doc_id:l type:s paragraph_index:l section_title:s", f"""
    SELECT doc_id, 'long_table_split_warning' AS type, caption_idx AS paragraph_index, concat('Таблица ', number, ' – ', title) AS section_title
    FROM ({_BOLD}) JOIN table_pairs USING (doc_id, tbl_no) WHERE n > 15""")
def _(f):
    return tables.long_table_split_warning(_rows(f), f.table_pairs)


_DECOR = r"SELECT doc_id, tbl_no, count(*) FILTER (regexp_replace(text, '[\s_().:;,–—\-]', '', 'g') <> '') AS m FROM table_cells GROUP BY doc_id, tbl_no HAVING m < 2"


@query("T4_decorative_table", "doc_id:l tbl_no:l", f"SELECT doc_id, tbl_no FROM ({_DECOR})")
def _(f):
    from galley.fixtures import table_cells
    return tables.decorative_tables(table_cells(_rows(f)))


@query("T5_row_page_groups", "doc_id:l tbl_no:l part:l on_page:l rows:l", "SELECT doc_id, tbl_no, part, on_page, rows FROM page_groups")
def _(f):
    return tables.row_page_groups(_rows(f))


_ELIGIBLE = f"""SELECT p.doc_id, p.tbl_no, p.number, g.pages FROM table_pairs p
    JOIN (SELECT doc_id, tbl_no, count(*) AS pages FROM page_groups GROUP BY doc_id, tbl_no) g ON p.doc_id = g.doc_id
    WHERE p.doc_id IN (SELECT doc_id FROM table_rows GROUP BY doc_id HAVING count(*) >= 3) AND p.doc_id NOT IN (SELECT doc_id FROM ({_DECOR}))"""


def _eligible(f):
    from galley.fixtures import table_cells
    return f._written("eligible", lambda: tables.split_eligible(_rows(f), table_cells(_rows(f)), f.table_pairs))


@query("T6_split_eligibility", "doc_id:l tbl_no:l number:s pages:l", _ELIGIBLE)
def _(f):
    return _eligible(f)


_FRAGMENTS = f"""
    SELECT r.doc_id, r.tbl_no, r.row_no, r.cell_1, e.number, g.part, row_number() OVER (PARTITION BY r.doc_id, g.part ORDER BY r.row_no) AS place
    FROM page_rows r JOIN ({_ELIGIBLE}) e ON r.doc_id = e.doc_id JOIN page_groups g ON r.doc_id = g.doc_id AND r.on_page = g.on_page
    UNION ALL SELECT r.doc_id, r.tbl_no, r.row_no, r.cell_1, e.number, g.part, 0 FROM table_rows r JOIN ({_ELIGIBLE}) e ON r.doc_id = e.doc_id
      JOIN page_groups g ON r.doc_id = g.doc_id WHERE r.row_no = 0"""


@query("T7_table_fragments", "doc_id:l tbl_no:l row_no:l cell_1:s part:l place:l label:s",
       f"SELECT *, CASE WHEN part > 1 THEN concat('Продолжение таблицы ', number) END AS label FROM ({_FRAGMENTS})")
def _(f):
    return tables.table_fragments(_rows(f), _eligible(f))


@query("T8_merge_fragments", "doc_id:l whole_tbl:l whole_row:l cell_1:s", f"""
    SELECT r.doc_id, 0 AS whole_tbl, r.row_no AS whole_row, r.cell_1 FROM table_rows r JOIN ({_ELIGIBLE}) e ON r.doc_id = e.doc_id""")
def _(f):
    parts = f._written("fragments", lambda: tables.table_fragments(_rows(f), _eligible(f)))
    split = parts.select(
        "doc_id", (F.col("part") - 1).cast("int").alias("tbl_no"), F.col("place").cast("int").alias("row_no"), "cell_1", "label"
    )
    return tables.merge_fragments(split)
