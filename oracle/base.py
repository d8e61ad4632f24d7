"""Common table expressions in DuckDB SQL, written independently of the Spark code.

``with_ctes`` finds the expressions a query mentions and puts them in front.
"""

from __future__ import annotations

import re

from galley.fixtures import BODY, EXTRA, LAYOUT, REST
from galley import rules as ru

RULES = ru.default_rules()
WS = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
EDGE = WS + r"\x{200B}"
NOTWORD = r"([^\p{L}\p{N}_]|$)"
CHAPTER = "глава|раздел|часть|chapter|section|part"
NUM = r"\d+(?:\.\d+){0,3}"


def q(values) -> str:
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{EDGE}]+|[{EDGE}]+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(lower(regexp_replace({x}, '[{WS}]+', ' ', 'g')))"


def squash(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^0-9a-zа-яё]+', ' ', 'g'))"


def rx(x: str, pattern: str, opts: str = "") -> str:
    tail = f", '{opts}'" if opts else ""
    return f"regexp_matches({x}, '{pattern}'{tail})"


def ints(x: str) -> str:
    """'1.2' as a list of numbers."""
    return f"list_transform(string_split({x}, '.'), lambda t: TRY_CAST(t AS BIGINT))"


def shorten(x: str) -> str:
    return f"CASE WHEN length({x}) > 80 THEN concat(substr({x}, 1, 79), '…') ELSE {x} END"


CAPTION = (
    r"^(?:рисунок|рис\.|таблица|табл\.|листинг)\s+\d+(?:\.\d+)*(?:\s*[:–—-]\s*|\.\s+)\S"
    rf"|^(?:продолжение|окончание)\s+таблицы\s+\d+(?:\.\d+)*{NOTWORD}"
    rf"|^формула\s+\(?\d+(?:\.\d+)*\)?{NOTWORD}"
)
CHAP_RX = rf"^\s*({CHAPTER})\s+({NUM}|[ivxlcdm]+)(?:[.)])?(?:\s*[:\-–—]\s*|\s+)?(.*)$"
NUM_RX = rf"^\s*({NUM})([.)]?)(.*)$"
ROMAN_RX = r"^(m{0,3})(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def roman(x: str) -> str:
    def place(group: int, nine: str, four: str, five: str, one: str) -> str:
        g = f"regexp_extract(lower({x}), '{ROMAN_RX}', {group})"
        return (
            f"CASE {g} WHEN '{nine}' THEN 9 WHEN '{four}' THEN 4 ELSE "
            f"CASE WHEN starts_with({g}, '{five}') THEN 5 ELSE 0 END + length(replace({g}, '{five}', '')) END"
        )

    total = (
        f"(1000 * length(regexp_extract(lower({x}), '{ROMAN_RX}', 1)) + 100 * ({place(2, 'cm', 'cd', 'd', 'c')})"
        f" + 10 * ({place(3, 'xc', 'xl', 'l', 'x')}) + ({place(4, 'ix', 'iv', 'v', 'i')}))"
    )
    return f"CASE WHEN regexp_matches(lower({x}), '{ROMAN_RX}') THEN nullif({total}, 0) END"


PREFIX = f"""
    SELECT *,
      CASE WHEN chw <> '' AND chtok[1] IS NOT NULL THEN 'chapter_word'
           WHEN nmn <> '' AND nmtitle <> '' AND (nmt <> '' OR regexp_matches(nmr, '^[{WS}]')) THEN 'number' END AS pk,
      CASE WHEN pk = 'chapter_word' THEN chtok WHEN pk = 'number' THEN {ints('nmn')} END AS ptok,
      array_to_string(ptok, '.') AS pnum, CASE WHEN pk IS NOT NULL THEN least(len(ptok), 3) END AS plevel,
      CASE WHEN pk = 'chapter_word' THEN chtitle WHEN pk = 'number' THEN nmtitle END AS ptitle,
      CASE WHEN pk = 'chapter_word' THEN lower(chw) END AS pword
    FROM (SELECT *,
      CASE WHEN regexp_matches(chn, '^\\d') THEN {ints('chn')} ELSE [CAST({roman('chn')} AS BIGINT)] END AS chtok,
      {strip('cht')} AS chtitle, {strip('nmr')} AS nmtitle
    FROM (SELECT *,
      regexp_extract(stripped, '{CHAP_RX}', 1, 'i') AS chw, regexp_extract(stripped, '{CHAP_RX}', 2, 'i') AS chn,
      regexp_extract(stripped, '{CHAP_RX}', 3, 'i') AS cht,
      regexp_extract(stripped, '{NUM_RX}', 1) AS nmn, regexp_extract(stripped, '{NUM_RX}', 2) AS nmt,
      regexp_extract(stripped, '{NUM_RX}', 3) AS nmr
    FROM %s))"""

BASIC = f"""
    SELECT *, length(stripped) AS length, {norm('stripped')} AS norm,
      CASE WHEN stripped = '' THEN 0 ELSE len(string_split({norm('stripped')}, ' ')) END AS word_count,
      regexp_matches(stripped, '[.!?]$') AS per, upper(stripped) = stripped AND lower(stripped) <> stripped AS is_upper,
      stripped = '' AS is_empty,
      CASE WHEN regexp_extract(stripped, '^({NUM})[.)]?\\s+', 1) <> ''
           THEN {ints(f"regexp_extract(stripped, '^({NUM})[.)]?[{WS}]+', 1)")} ELSE [] END AS ntok,
      length(stripped) >= 100 AND length(stripped) - length(replace(stripped, ',', '')) >= 3 AS dense
    FROM %s"""

_LETTERS_UPPER = "regexp_matches(stripped, '\\p{Lu}') AND NOT regexp_matches(stripped, '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]')"
_KEYWORDS = (
    "(?:def|class|import|from|return|if|elif|else|for|while|try|except|with|const|let|var|function|public|"
    "private|protected|static|select|insert|update|delete)"
)
_CODE_KEYWORD = rf"^\s*{_KEYWORDS}{NOTWORD}|[{{}}]"
_CODE_LIKE = rf"{_CODE_KEYWORD}|[\p{{L}}\p{{N}}_]+\s*\([^)]*\)"

CTES: dict[str, str] = {}

CTES["base_lines"] = """
    SELECT doc_id, i - 1 AS ln, l[i] AS txt FROM (
      SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
CTES["line_basic"] = BASIC % f"(SELECT doc_id, ln AS idx, txt AS text, {strip('txt')} AS stripped FROM base_lines)"
_EXTRA = ", ".join(f"({m}, {k}, {p}, {t!r})" for m, lines in EXTRA.items() for k, (t, p) in enumerate(lines))
CTES["para_text"] = f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, k, r) - 1 AS idx, text,
      CASE part WHEN 1 THEN k - 12 WHEN 2 THEN 0 WHEN 3 THEN CASE r WHEN 0 THEN k + 1 ELSE 0 END WHEN 2.5 THEN r ELSE tail END AS pos,
      CAST(CASE part WHEN 3 THEN (k + r) // 10 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 2.5 THEN 0 ELSE (tail - 1) // 10 END AS INT) AS tables_before
    FROM (SELECT *, n_lines + row_number() OVER (PARTITION BY doc_id, part > 3 ORDER BY part, k) AS tail FROM (
      SELECT doc_id, 1 AS part, k, 0 AS r, CASE k WHEN 0 THEN 'Государственный университет' WHEN 1 THEN 'Факультет наук'
        WHEN 2 THEN 'Кафедра методов'
        WHEN 3 THEN CASE WHEN doc_id % 10 = 0 THEN 'Выпускная квалификационная работа' ELSE 'Отчёт по теме исследования' END
        WHEN 5 THEN 'Город 2024' WHEN 6 THEN CASE WHEN doc_id % 3 = 0 THEN 'Оглавление' ELSE 'СОДЕРЖАНИЕ' END
        WHEN 7 THEN CASE doc_id % 15 WHEN 0 THEN 'Введение ........ 3' WHEN 5 THEN 'Введение' ELSE 'Первая глава о методах' END
        WHEN 8 THEN CASE doc_id % 15 WHEN 0 THEN concat('1 Раздел', chr(9), '5') WHEN 5 THEN 'ЗАКЛЮЧЕНИЕ' ELSE 'Вторая глава о данных' END
        WHEN 9 THEN CASE doc_id % 15 WHEN 0 THEN 'Заключение — 9' WHEN 5 THEN 'Список использованных источников' ELSE 'Третья часть' END
        WHEN 10 THEN CASE doc_id % 15 WHEN 0 THEN 'Список литературы    12' WHEN 5 THEN '' ELSE 'Термины и определения' END
        ELSE '' END AS text
      FROM (SELECT doc_id, unnest(range(12)) AS k FROM documents WHERE doc_id % 5 = 0)
      UNION ALL SELECT doc_id, 2, 0, 0, CASE WHEN doc_id % 4 = 0 THEN 'Предисловие' ELSE 'ВВЕДЕНИЕ' END FROM documents
      UNION ALL SELECT doc_id, 2.5, x.k, x.pos, x.text FROM documents JOIN (VALUES {_EXTRA}) x(m, k, pos, text) ON doc_id % 21 = x.m
      UNION ALL SELECT doc_id, 3, ln, 0, {BODY} FROM base_lines
      UNION ALL SELECT doc_id, 3, ln, 1, {REST} FROM base_lines WHERE {REST} <> ''
      UNION ALL SELECT doc_id, 3.5, 0, 0, 'Термины и определения' FROM documents WHERE doc_id % 19 = 7
      UNION ALL SELECT doc_id, 4, 0, 0, 'ЗАКЛЮЧЕНИЕ' FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 19 <> 6
      UNION ALL SELECT doc_id, 6.5, 0, 0, 'ЗАКЛЮЧЕНИЕ' FROM documents WHERE doc_id % 19 = 6
      UNION ALL SELECT doc_id, 5, 0, 0, CASE doc_id % 8 WHEN 0 THEN 'Список литературы' WHEN 1 THEN 'Список литературы ........ 41'
        ELSE 'СПИСОК ИСПОЛЬЗОВАННЫХ ИСТОЧНИКОВ' END FROM documents WHERE doc_id % 13 <> 0
      UNION ALL SELECT doc_id, 6, k, 0, CASE
        WHEN doc_id % 17 = 0 AND k = 2 THEN '18-32. Автор Б. Б. Сборник трудов'
        WHEN doc_id % 10 = 4 AND k >= 4 THEN concat('Автор В. В. Статья номер ', CAST(k AS STRING), ', 2019. 5 с.')
        ELSE concat(CAST(k + CASE WHEN doc_id % 11 = 0 AND k > 3 THEN 1 ELSE 0 END AS STRING), '. Автор А. А. Работа о методах',
          CASE WHEN (doc_id + k) % 6 = 0 THEN '' ELSE concat(', ', CAST(2010 + k AS STRING), '. 10 с.') END) END
        FROM (SELECT doc_id, unnest(range(1, 7)) AS k FROM documents WHERE doc_id % 13 <> 0)
      UNION ALL SELECT doc_id, 7, 1, 0, 'схема данных' FROM documents WHERE doc_id % 14 = 6
      UNION ALL SELECT doc_id, 7, 2 * k, 0, CASE WHEN k = 0 THEN 'ПРИЛОЖЕНИЕ А' WHEN doc_id % 6 = 0 THEN 'ПРИЛОЖЕНИЕ В'
        WHEN doc_id % 14 = 2 THEN 'ПРИЛОЖЕНИЕ З' ELSE 'ПРИЛОЖЕНИЕ Б' END
        FROM (SELECT doc_id, unnest(range(2)) AS k FROM documents WHERE doc_id % 2 = 0))
    JOIN (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents) USING (doc_id))"""
CTES["paras"] = (
    "SELECT *, "
    + ", ".join(f"{v} AS {k}" for k, v in LAYOUT.items())
    + " FROM para_text"
)
CTES["feat"] = f"""
    SELECT *, CASE WHEN regexp_extract(lower({strip('style_name')}), '^(?:heading|заголовок)\\s*(\\d+)$', 1) <> ''
        THEN greatest(1, least(3, CAST(regexp_extract(lower({strip('style_name')}), '^(?:heading|заголовок)\\s*(\\d+)$', 1) AS INT))) END AS native,
      CASE WHEN len(ntok) > 0 THEN ntok WHEN pk = 'number' THEN ptok ELSE [] END AS vis
    FROM ({PREFIX % ('(' + BASIC % ('(SELECT *, ' + strip('text') + ' AS stripped FROM paras)') + ')')})"""
CTES["titles"] = f"""
    SELECT doc_id, CASE WHEN marked OR (centred >= 4 AND context >= 2) THEN coalesce(boundary, least(n, 25)) ELSE 0 END AS title_end, n
    FROM (SELECT doc_id, max(idx) + 1 AS n,
      bool_or(idx < 60 AND NOT is_empty AND ({" OR ".join(f"contains(norm, '{m}')" for m in ru.title_markers(RULES))})) AS marked,
      count(*) FILTER (idx < 60 AND NOT is_empty AND alignment = 'center' AND length <= 120) AS centred,
      count(*) FILTER (idx < 60 AND NOT is_empty AND ({" OR ".join(f"contains(norm, '{m}')" for m in ru.TITLE_CONTEXT)})) AS context,
      min(idx) FILTER (NOT is_empty AND (norm IN ('содержание', 'оглавление', 'введение')
        OR {rx('stripped', r'^\d+[.)]?\s+\S')} OR {rx('stripped', rf'^(?:{CHAPTER})\s+\d+', 'i')}
        OR outline_level = 0 OR numpr_ilvl = 0)) AS boundary
      FROM feat GROUP BY doc_id)"""
CTES["toc_head"] = "SELECT doc_id, min(idx) AS head FROM feat WHERE norm IN ('содержание', 'оглавление') GROUP BY doc_id"
CTES["toc_rows"] = f"""
    SELECT f.doc_id, f.idx, head, is_empty, f.table_follows,
      {rx("lower(style_name)", r'^(?:toc|оглавление|содержание)\s*\d*$')} OR (stripped <> '' AND
        regexp_matches(stripped, '\\.{{3,}}\\s*\\d+\\s*\\.?\\s*$|\\t\\s*\\d{{1,3}}\\s*\\.?\\s*$|\\s{{3,}}\\d{{1,3}}\\s*\\.?\\s*$|[—–-]\\s*\\d{{1,3}}\\s*\\.?\\s*$')) AS entry,
      stripped <> '' AND ({rx("lower(style_name)", r'^(heading|заголовок)\s*[1-3]$')} OR coalesce(outline_level BETWEEN 0 AND 2, false)
        OR norm IN {q(ru.all_aliases(RULES))} OR {rx('stripped', rf'^(?:{CHAPTER})\s+\d+', 'i')}
        OR {rx('stripped', r'^приложение\s+[а-яёa-z]', 'i')} OR (length <= 80 AND {_LETTERS_UPPER})) AS structural,
      length >= 80 AND NOT ({_LETTERS_UPPER}) AND NOT {rx('stripped', rf'^(?:{CHAPTER})\s+\d+', 'i')}
        AND NOT {rx('stripped', r'^\d+[\.\d]*[\.\)]\s')} AND length(regexp_replace(stripped, '\\P{{Ll}}', '', 'g')) >= 10 AS body,
      is_empty OR max(f.idx) OVER (PARTITION BY f.doc_id, norm) <= f.idx AS unrepeated
    FROM feat f JOIN toc_head h ON f.doc_id = h.doc_id"""
CTES["toc_limits"] = """
    SELECT l.*, (SELECT min(r.idx) FROM toc_rows r WHERE r.doc_id = l.doc_id AND r.idx > l.first_entry AND NOT r.entry AND NOT r.is_empty) AS entries_end
    FROM (SELECT doc_id, min(idx) FILTER (idx > head AND entry) AS first_entry, min(idx) FILTER (idx > head AND unrepeated) AS stop,
      least(min(idx) FILTER (idx > head AND (structural OR body)), min(idx) FILTER (idx >= head AND table_follows)) AS boundary
      FROM toc_rows GROUP BY doc_id) l"""
CTES["toc_lines"] = """
    SELECT r.doc_id, r.idx, CASE WHEN first_entry IS NOT NULL THEN 1 WHEN stop - head - 1 >= 2 THEN 2 ELSE 3 END AS phase
    FROM toc_rows r JOIN toc_limits l ON r.doc_id = l.doc_id WHERE r.idx > head AND CASE
      WHEN first_entry IS NOT NULL THEN entry AND (entries_end IS NULL OR r.idx < entries_end)
      WHEN stop - head - 1 >= 2 THEN r.idx < stop
      ELSE r.idx < boundary AND NOT structural END"""
CTES["zone"] = """
    SELECT f.*, f.idx < t.title_end AS in_title, c.idx IS NOT NULL AS in_toc, f.idx < t.title_end OR c.idx IS NOT NULL AS skip
    FROM feat f JOIN titles t ON f.doc_id = t.doc_id LEFT JOIN toc_lines c ON f.doc_id = c.doc_id AND f.idx = c.idx"""
CTES["list_numbers"] = """
    SELECT doc_id, idx, concat(repeat('1.', CAST(numpr_ilvl AS INT)), CASE WHEN same AND numpr_ilvl <= pl THEN '2' ELSE '1' END) AS auto_number FROM (
      SELECT *, lag(numpr_num_id) OVER w = numpr_num_id AND len(lag(ntok) OVER w) = 0 AS same, lag(numpr_ilvl) OVER w AS pl
      FROM feat WHERE NOT is_empty WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
    WHERE numpr_num_id IS NOT NULL AND len(ntok) = 0"""
CTES["body_size"] = """
    SELECT doc_id, coalesce(arg_max(size, [k, n, -f]), 14.0) AS body_size FROM (
      SELECT doc_id, k, size, count(*) AS n, min(idx) AS f FROM (
        SELECT doc_id, idx, 1 AS k, modal_font_size_pt AS size FROM feat
          WHERE NOT is_empty AND length >= 120 AND bold_ratio < 0.2 AND len(ntok) = 0
        UNION ALL SELECT doc_id, idx, 0, round(modal_font_size_pt, 1) FROM feat WHERE NOT is_empty)
      GROUP BY doc_id, k, size) GROUP BY doc_id"""
CTES["near"] = """
    SELECT z.*, last_value(CASE WHEN NOT is_empty THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv,
      first_value(CASE WHEN NOT is_empty THEN s END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx
    FROM (SELECT *, {'len': length, 'tok': vis, 'bold': bold_ratio, 'per': per} AS s FROM zone) z"""

_KW = q(ru.aliases(RULES, *ru.CANONICAL_SECTIONS))
_BANNED = q([k for k, v in ru.forbidden_rows(RULES) if v is None])
CTES["sig0"] = f"""
    SELECT n.*, coalesce(b.body_size, 14.0) AS body_size,
      CASE WHEN numpr_num_id IS NOT NULL THEN count(*) FILTER (NOT is_empty) OVER (PARTITION BY n.doc_id, numpr_num_id) ELSE 0 END AS grp,
      CASE WHEN pk = 'number' THEN ptok ELSE ntok END AS num,
      coalesce(pnum, CASE WHEN len(ntok) > 0 THEN array_to_string(ntok, '.') END, a.auto_number) AS shown,
      coalesce(pk = 'chapter_word', false) AS chap, ends_with(stripped, ':') AS colon,
      coalesce(outline_level BETWEEN 0 AND 2, false) AS outl, coalesce(numpr_ilvl BETWEEN 0 AND 2, false) AS nump,
      {rx('norm', r'^приложение\s+[а-яё]')} AS appx, norm IN {_KW} AS kw,
      coalesce(nullif(max_font_size_pt, 0), modal_font_size_pt) AS fsize
    FROM near n LEFT JOIN body_size b ON n.doc_id = b.doc_id
      LEFT JOIN list_numbers a ON n.doc_id = a.doc_id AND n.idx = a.idx"""
CTES["sig1"] = f"""
    SELECT *, len(num) > 0 AND length <= 200 AND word_count <= 14 AND NOT per AS lit,
      pk = 'number' AND len(num) >= 2 AND (native IS NOT NULL OR outl OR nump) AS vnl,
      fsize >= body_size + 2 AS big, fsize >= body_size + 1 AND fsize < body_size + 2 AS medium_size,
      coalesce(pv.len, 0) >= 120 AND coalesce(nx.len, 0) >= 120 AS iso,
      length <= 100 AND word_count <= 14 AS short, alignment = 'center' AS cent, is_upper AND length <= 80 AS caps,
      coalesce(first_line_indent_cm < -0.1, false) AS hang,
      native IS NOT NULL OR outl OR chap OR appx OR kw AS anchor,
      {rx('stripped', r'^\p{Ll}')} AS low_start, {rx('stripped', r'[а-яa-z][.!?]\s+[А-ЯA-Z]')} AS inner_s,
      chap AND word_count <= 14 AND NOT per AND NOT colon AND NOT dense AS strict,
      CASE WHEN is_empty AND (skip OR in_table OR native IS NULL) THEN 'empty' WHEN is_empty THEN NULL
        WHEN in_table THEN 'in_table' WHEN skip THEN 'title_page' WHEN {rx('stripped', CAPTION, 'i')} THEN 'caption'
        WHEN length > 200 THEN 'too_long'
        WHEN regexp_matches(lower(style_name), '^(toc|оглавление|table of contents)')
          OR (has_tab AND {rx('stripped', r'\d+\s*\.?\s*$')}) THEN 'toc_entry'
        WHEN norm IN {_BANNED} THEN 'forbidden' WHEN len(num) > 0 AND dense THEN 'dense_numbered_body'
        WHEN numpr_num_id IS NOT NULL AND numpr_ilvl IS NOT NULL AND NOT strict AND (grp >= 4 OR per
          OR (native IS NULL AND (ends_with(stripped, ';') OR lower(style_name) IN ('list paragraph', 'listparagraph', 'абзац списка')))) THEN 'list_item'
        WHEN per AND length > 60 AND bold_ratio < 0.3 AND native IS NULL AND NOT chap THEN 'body_text'
        WHEN colon AND native IS NULL AND pk IS NULL AND NOT outl THEN 'lead_in_colon' END AS early
    FROM sig0"""
CTES["sig2"] = """
    SELECT *, native IS NOT NULL OR outl OR chap OR appx OR kw OR lit OR nump AS strong,
      native IS NOT NULL OR outl OR nump AS templ, len(num) = 1 AND NOT (chap OR appx OR kw) AS single,
      len(pv.tok) = 1 AND pv.tok[1] = num[1] - 1 AS seq_prev, len(nx.tok) = 1 AND nx.tok[1] = num[1] + 1 AS seq_next,
      CASE WHEN native IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN outl THEN 10 ELSE 0 END + CASE WHEN nump THEN 4 ELSE 0 END
      + CASE WHEN chap THEN 10 ELSE 0 END + CASE WHEN appx THEN 10 ELSE 0 END + CASE WHEN kw THEN 10 ELSE 0 END
      + CASE WHEN lit THEN 6 ELSE 0 END + CASE WHEN big THEN 4 WHEN medium_size THEN 2 ELSE 0 END
      + CASE WHEN bold_ratio >= 0.8 THEN 3 WHEN bold_ratio >= 0.5 THEN 2 ELSE 0 END + CASE WHEN cent THEN 3 ELSE 0 END
      + CASE WHEN caps THEN 3 ELSE 0 END + CASE WHEN short THEN 1 ELSE 0 END + CASE WHEN iso THEN 3 ELSE 0 END
      + CASE WHEN NOT per THEN 1 ELSE 0 END + CASE WHEN has_page_break_before THEN 3 ELSE 0 END
      - CASE WHEN hang AND anchor THEN 5 ELSE 0 END - CASE WHEN low_start AND NOT anchor THEN 5 ELSE 0 END
      - CASE WHEN inner_s THEN 4 ELSE 0 END - CASE WHEN colon THEN 2 ELSE 0 END - CASE WHEN dense THEN 3 ELSE 0 END AS raw
    FROM sig1"""
CTES["scored"] = """
    SELECT *, CASE WHEN reject IS NOT NULL THEN 0 WHEN is_empty THEN 10 WHEN NOT strong AND raw >= 6 THEN 3 ELSE raw END AS score,
      CASE WHEN score >= 10 THEN 'high' WHEN score >= 6 THEN 'medium' WHEN score >= 3 THEN 'low' ELSE 'none' END AS tier,
      CASE WHEN reject IS NOT NULL THEN 2 WHEN is_empty THEN native ELSE greatest(1, least(3,
        CASE WHEN vnl THEN plevel WHEN lit THEN least(len(num), 3) WHEN kw OR appx THEN 1
          WHEN chap THEN CASE WHEN pword IN ('раздел', 'section') AND len(ptok) > 1 THEN plevel ELSE 1 END
          WHEN native IS NOT NULL THEN native WHEN outl THEN outline_level + 1 WHEN nump THEN numpr_ilvl + 1 ELSE 2 END)) END AS level,
      CASE WHEN reject IS NULL AND NOT is_empty THEN shown END AS number,
      CASE WHEN reject IS NOT NULL THEN [] WHEN is_empty THEN ['native_style_empty'] ELSE list_filter([
        CASE WHEN native IS NOT NULL THEN concat('native_style:', native) END, CASE WHEN outl THEN concat('outline_level:', outline_level) END,
        CASE WHEN nump THEN concat('numpr_ilvl:', numpr_ilvl) END, CASE WHEN chap THEN 'chapter_word' END, CASE WHEN appx THEN 'appendix' END,
        CASE WHEN kw THEN 'structural_keyword' END, CASE WHEN lit THEN concat('literal_number:', coalesce(shown, 'None')) END,
        CASE WHEN vnl THEN concat('visible_number_level:', coalesce(shown, 'None')) END,
        CASE WHEN big THEN printf('font_large:%.1f', fsize) WHEN medium_size THEN printf('font_small:%.1f', fsize) END,
        CASE WHEN bold_ratio >= 0.8 THEN printf('bold:%.2f', bold_ratio) WHEN bold_ratio >= 0.5 THEN printf('bold_partial:%.2f', bold_ratio) END,
        CASE WHEN cent THEN 'centered' END, CASE WHEN caps THEN 'all_caps' END, CASE WHEN short THEN 'short' END,
        CASE WHEN iso THEN 'isolated' END, CASE WHEN NOT per THEN 'no_period' END, CASE WHEN has_page_break_before THEN 'page_break_before' END,
        CASE WHEN hang AND anchor THEN 'hanging_indent_penalty' END, CASE WHEN low_start AND NOT anchor THEN 'lowercase_start' END,
        CASE WHEN inner_s THEN 'internal_sentence' END, CASE WHEN colon THEN 'ends_with_colon' END, CASE WHEN dense THEN 'dense_text' END,
        CASE WHEN NOT strong AND raw >= 6 THEN 'no_strong_signal_capped' END], lambda x: x IS NOT NULL) END AS signals
    FROM (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN is_empty THEN NULL
        WHEN hang AND NOT anchor THEN 'hanging_indent'
        WHEN per AND NOT (native IS NOT NULL OR chap OR kw OR appx) AND len(num) < 2 THEN 'ends_with_period'
        WHEN NOT strong AND bold_ratio >= 0.8 AND length <= 80 AND pv.bold >= 0.8 AND pv.len <= 80 AND NOT pv.per
          AND nx.bold >= 0.8 AND nx.len <= 80 AND NOT nx.per THEN 'inline_enum'
        WHEN single AND strong AND NOT templ AND (seq_prev OR seq_next) THEN 'list_sequence'
        WHEN single AND templ AND ((seq_prev AND pv.len <= 120 AND NOT pv.per) OR (seq_next AND nx.len <= 120 AND NOT nx.per)) THEN 'list_sequence'
        END AS reject FROM sig2)"""
CTES["sure"] = f"""
    SELECT doc_id, idx, number, {ints('number')} AS tok, len(tok) AS depth, array_to_string(tok[1:len(tok) - 1], '.') AS parent, tok[len(tok)] AS part
    FROM scored WHERE tier = 'high' AND regexp_matches(number, '^\\d+(\\.\\d+)*$')"""
CTES["low"] = f"""
    SELECT doc_id, idx, number, {ints('number')} AS tok, len(tok) AS depth, array_to_string(tok[1:len(tok) - 1], '.') AS parent, tok[len(tok)] AS part,
      native IS NOT NULL OR outl OR nump OR bold_ratio >= 0.5 OR cent OR caps OR big OR medium_size OR has_page_break_before AS visual
    FROM scored WHERE tier = 'low' AND NOT regexp_matches(stripped, '^(содержание|оглавление)$', 'i') AND regexp_matches(number, '^\\d+(\\.\\d+)*$')"""
CTES["saved"] = """
    SELECT doc_id, idx, CASE WHEN before < idx AND idx < after THEN 'gap' ELSE 'first_child' END AS how FROM (
      SELECT l.*, (SELECT max(s.idx) FROM sure s WHERE s.doc_id = l.doc_id AND s.depth = l.depth AND s.parent = l.parent AND s.part < l.part) AS before,
        (SELECT min(s.idx) FROM sure s WHERE s.doc_id = l.doc_id AND s.depth = l.depth AND s.parent = l.parent AND s.part > l.part) AS after,
        EXISTS (SELECT 1 FROM sure s WHERE s.doc_id = l.doc_id AND array_to_string(s.tok, '.') = l.parent AND s.idx < l.idx) AS has_parent,
        EXISTS (SELECT 1 FROM sure s WHERE s.doc_id = l.doc_id AND s.depth = l.depth AND s.parent = l.parent AND s.part > 1 AND s.idx > l.idx) AS has_sibling
      FROM low l)
    WHERE (before < idx AND idx < after) OR (depth >= 2 AND part = 1 AND visual AND has_parent AND has_sibling)"""
CTES["accepted"] = """
    SELECT s.*, CASE WHEN tier = 'high' THEN 'high' ELSE 'low_recovered' END AS source, coalesce(ptitle, stripped) AS title_only
    FROM scored s LEFT JOIN saved v ON s.doc_id = v.doc_id AND s.idx = v.idx WHERE tier = 'high' OR v.idx IS NOT NULL"""
CTES["heads"] = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN norm = '' THEN concat('#', idx) ELSE norm END ORDER BY idx) AS rn
      FROM accepted) WHERE rn = 1"""
CTES["head_title"] = f"SELECT *, {norm('title_only')} AS title_norm FROM heads"
CTES["bib_start"] = f"""
    SELECT doc_id, min(idx) + 1 AS start FROM feat WHERE NOT is_empty AND (norm IN {q(ru.aliases(RULES, 'references'))}
      OR (length(norm) < 80 AND (contains(norm, 'источник') OR contains(norm, 'литератур') OR contains(norm, 'библиограф')))) GROUP BY doc_id"""
CTES["bib_range"] = """
    SELECT bs.doc_id, bs.start, (SELECT min(h.idx) FROM heads h WHERE h.doc_id = bs.doc_id AND h.idx >= bs.start) AS stop FROM bib_start bs"""
_DASH = r"\-‒–—−"
_IN = rf"\d+(?:\s*[,{_DASH}]\s*\d+)*"
CTES["cited"] = f"""
    SELECT doc_id, idx, token_no, raw_token, part_no, unnest(range(lo, hi + 1)) AS n, unnest(range(0, hi - lo + 1)) AS n_pos FROM (
      SELECT *, TRY_CAST(trim(regexp_split_to_array(trim(part), '\\s*[{_DASH}]\\s*')[1]) AS BIGINT) AS lo,
        TRY_CAST(CASE WHEN regexp_matches(part, '[{_DASH}]') THEN regexp_replace(trim(part), '^[^{_DASH}]*[{_DASH}]\\s*', '') ELSE trim(part) END AS BIGINT) AS hi
      FROM (SELECT doc_id, idx, token_no, raw_token, unnest(parts) AS part, unnest(range(0, len(parts))) AS part_no FROM (
        SELECT *, string_split(replace(replace(raw_token, '[', ''), ']', ''), ',') AS parts FROM (
          SELECT z.doc_id, z.idx, unnest(m) AS raw_token, unnest(range(0, len(m))) AS token_no FROM (
            SELECT z.doc_id, z.idx, regexp_extract_all(stripped, '\\[{_IN}\\]') AS m FROM zone z LEFT JOIN bib_start b ON z.doc_id = b.doc_id
            WHERE NOT in_title AND NOT is_empty AND (b.start IS NULL OR z.idx < b.start)) z)))) WHERE lo <= hi"""
CTES["first_cited"] = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY idx, token_no, part_no, n_pos) AS rn FROM cited) WHERE rn = 1"""
CTES["listed"] = """
    SELECT z.doc_id, z.idx, stripped, numpr_num_id FROM zone z JOIN bib_range b ON z.doc_id = b.doc_id
    WHERE NOT is_empty AND z.idx >= b.start AND (b.stop IS NULL OR z.idx < b.stop)"""
_CONT = rf"^(?:№|n{NOTWORD}|no\.?|с\.|стр\.|pp?\.|url{NOTWORD}|doi{NOTWORD}|\[электронный ресурс\])"
CTES["entries"] = f"""
    SELECT doc_id, idx, CASE WHEN kind = 'auto' THEN coalesce(sum(1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1
      ELSE TRY_CAST(num AS BIGINT) END AS number, CASE WHEN kind = 'auto' THEN stripped ELSE body END AS body FROM (
      SELECT *, CASE WHEN num <> '' THEN CASE WHEN regexp_matches(body, '{_CONT}', 'i') THEN 'other' ELSE 'typed' END
        WHEN numpr_num_id IS NOT NULL THEN 'auto' ELSE 'other' END AS kind
      FROM (SELECT *, regexp_extract(stripped, '^(\\d+)[.)]\\s+(.*)$', 1) AS num, {strip("regexp_extract(stripped, '^(\\d+)[.)]\\s+(.*)$', 2)")} AS body FROM listed))
    WHERE kind <> 'other'"""
CTES["appendices"] = """
    SELECT doc_id, idx, letter, CASE WHEN p > 0 THEN p - 1 END AS place FROM (
      SELECT *, instr('АБВГДЕЖИКЛМНПРСТУФХЦШЩЭЮЯ', letter) AS p FROM (
        SELECT doc_id, idx, translate(upper(regexp_extract(stripped, '^приложение\\s+([а-яёa-z])([^\\p{L}\\p{N}_]|$)', 1, 'i')), 'ABCEHKMOPTX', 'АВСЕНКМОРТХ') AS letter
        FROM heads) WHERE letter <> '')"""
CTES["mentions"] = """
    SELECT doc_id, letter, min(idx) AS first_ref FROM (
      SELECT z.doc_id, z.idx, upper(unnest(regexp_extract_all(stripped, '(?:^|[^\\p{L}\\p{N}_])приложени[\\p{L}\\p{N}_]*\\s+([\\p{L}\\p{N}_]+)', 1, 'i'))) AS letter
      FROM zone z JOIN (SELECT doc_id, min(idx) AS first FROM appendices GROUP BY doc_id) a ON z.doc_id = a.doc_id
      WHERE NOT in_title AND NOT is_empty AND z.idx < a.first) WHERE length(letter) = 1 GROUP BY doc_id, letter"""
CTES["equations"] = f"""
    SELECT z.doc_id, z.idx, nullif(regexp_extract(stripped, '\\((\\d+(?:\\.\\d+)?)\\)\\s*$', 1), '') AS number, stripped AS text, has_tab,
      coalesce({rx('nxt', rf'^\s*где{NOTWORD}', 'i')}, false) AS explained
    FROM (SELECT *, first_value(CASE WHEN NOT is_empty THEN stripped END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM zone) z
    WHERE NOT in_title AND NOT is_empty AND NOT in_table AND contains(stripped, '=') AND length <= 120
      AND (alignment = 'center' OR regexp_matches(stripped, '\\(\\d+(?:\\.\\d+)?\\)\\s*$'))
      AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = z.doc_id AND h.idx = z.idx)"""
CTES["breaks"] = """
    SELECT doc_id, idx, chapter FROM (SELECT doc_id, idx, TRY_CAST(coalesce(nullif(regexp_extract(coalesce(number, ''), '^(\\d+)', 1), ''),
      nullif(regexp_extract(stripped, '^(\\d+)(?:[^\\p{L}\\p{N}_]|$)', 1), '')) AS BIGINT) AS chapter FROM heads WHERE level = 1) WHERE chapter IS NOT NULL"""
CTES["chaptered"] = """
    SELECT z.*, coalesce(last_value(b.chapter IGNORE NULLS) OVER (PARTITION BY z.doc_id ORDER BY z.idx ROWS UNBOUNDED PRECEDING), 0) AS chapter
    FROM zone z LEFT JOIN breaks b ON z.doc_id = b.doc_id AND z.idx = b.idx"""
CTES["code"] = f"""
    SELECT *, stripped <> '' AND NOT {rx('stripped', rf'^\s*листинг{NOTWORD}', 'i')} AND CASE
      WHEN mono THEN regexp_matches(text, '^[ \\t]') OR regexp_matches(stripped, '^\\s*\\d+\\s*[.)\\]]?\\s') OR {rx('stripped', _CODE_LIKE, 'i')}
      WHEN regexp_matches(stripped, '^\\s*\\d+\\s*[.)\\]]?\\s') THEN regexp_matches(regexp_replace(stripped, '^\\s*\\d+\\s*[.)\\]]?\\s', ''), '{_CODE_KEYWORD}', 'i')
      ELSE {rx('stripped', _CODE_KEYWORD, 'i')} END AS is_code FROM zone"""
CTES["code_lines"] = f"""
    SELECT doc_id, idx FROM (SELECT *, last_value(CASE WHEN in_title OR (NOT is_empty AND NOT is_code) THEN
        NOT in_title AND {rx('stripped', rf'^\s*листинг{NOTWORD}', 'i')} END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM code)
    WHERE open AND is_code AND NOT in_title"""


def _caption(word: str, kind: str) -> str:
    n = r"\d+(?:\.\d+)*"
    if kind == "listing":
        start, sep = rf"^{word}{NOTWORD}", rf"^{word}\s*(?:{n})?(?:\s*[:–—-]\s*|\.\s+)\S"
        parse = rf"^{word}\s*({n})?\s*[:.–—\-]?\s*(.*)$"
    else:
        start, sep = rf"^{word}\s+[\d–—\-]", rf"^{word}\s+{n}(?:\s*[:–—-]\s*|\.\s+)\S"
        parse = rf"^{word}\s+({n})\s*[:.–—\-]?\s*(.*)$"
    edge = r"^[ –—\-:.,]+|[ –—\-:.,]+$"
    loose = r"^[ –—\-,]+|[ –—\-,]+$"
    if kind == "table":
        real = f"next_is_table AND ({rx('stripped', sep, 'i')} OR NOT regexp_matches(stripped, '[.!?]$'))"
    else:
        real = f"({rx('stripped', sep, 'i')} OR alignment = 'center' OR coalesce(img, false))"
    if kind == "listing":
        real += f" AND coalesce(code_below, false) AND NOT {rx('stripped', rf'^приложение\s+[а-яё]{NOTWORD}', 'i')}"
    return f"""
    SELECT doc_id, idx, '{kind}' AS kind, stripped AS text, nullif(regexp_extract(stripped, '{parse}', 1, 'i'), '') AS original_number,
      CASE WHEN {rx('stripped', parse, 'i')} THEN regexp_replace(regexp_extract(stripped, '{parse}', 2, 'i'), '{edge}', '', 'g')
        ELSE regexp_replace(regexp_replace(stripped, '^[^ ]* ', ''), '{loose}', '', 'g') END AS title
    FROM (SELECT *, last_value(CASE WHEN has_image OR NOT is_empty THEN has_image END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS img,
      first_value(CASE WHEN in_title OR NOT is_empty THEN is_code AND NOT in_title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS code_below FROM code)
    WHERE NOT in_title AND {rx('stripped', start, 'i')} AND {real}"""


CTES["caps_raw"] = " UNION ALL ".join(
    _caption(w, k) for w, k in (("рисунок", "figure"), ("таблица", "table"), ("листинг", "listing"))
)
CTES["segments"] = """
    SELECT doc_id, idx AS spot, chapter FROM (SELECT *, coalesce(lag(chapter) OVER (PARTITION BY doc_id ORDER BY idx), 0) AS before FROM breaks)
    WHERE before <> chapter"""
CTES["marks"] = """
    SELECT doc_id, idx AS spot, upper(regexp_extract(stripped, '^приложение\\s+([а-яё])(?:[^\\p{L}\\p{N}_]|$)', 1, 'i')) AS letter FROM zone
    WHERE NOT in_title AND regexp_matches(stripped, '^приложение\\s+[а-яё](?:[^\\p{L}\\p{N}_]|$)', 'i')"""
CTES["caps"] = """
    SELECT doc_id, idx, kind, text, original_number, title,
      CASE WHEN letter IS NOT NULL THEN concat(letter, '.', n) WHEN chapter > 0 THEN concat(chapter, '.', n) ELSE CAST(n AS VARCHAR) END AS new_number
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, letter IS NOT NULL, spot ORDER BY idx) AS n FROM (
      SELECT c.*, m.letter, coalesce(s.chapter, 0) AS chapter, CASE WHEN m.letter IS NOT NULL THEN m.spot ELSE coalesce(s.spot, -1) END AS spot
      FROM caps_raw c ASOF LEFT JOIN segments s ON c.doc_id = s.doc_id AND c.idx >= s.spot
      ASOF LEFT JOIN (SELECT 'listing' AS kind, * FROM marks) m ON c.doc_id = m.doc_id AND c.kind = m.kind AND c.idx >= m.spot))"""
_REF = "(рисунок|рисунк[\\p{L}\\p{N}_]*|рис\\.?|таблица|таблиц[\\p{L}\\p{N}_]*|табл\\.?)([№ \\x{A0}]*)(\\d+(?:\\.\\d+)*(?:[ \\x{A0}]*(?:,|и)[ \\x{A0}]*\\d+(?:\\.\\d+)*)*)"
REF = _REF
CTES["refs"] = f"""
    SELECT doc_id, idx, span_no, phrase, CASE WHEN starts_with(lower(phrase), 'рис') THEN 'figure' ELSE 'table' END AS kind,
      unnest(nums) AS num, unnest(range(0, len(nums))) AS num_no FROM (
      SELECT *, regexp_extract_all(regexp_extract(phrase, '{_REF}', 3, 'i'), '\\d+(?:\\.\\d+)*') AS nums FROM (
        SELECT doc_id, idx, unnest(m) AS phrase, unnest(range(0, len(m))) AS span_no FROM (
          SELECT doc_id, idx, regexp_extract_all(stripped, '{_REF}', 0, 'i') AS m FROM zone z
          WHERE NOT in_title AND NOT is_empty AND NOT regexp_matches(stripped, '^\\s*(продолжение|окончание)\\s+таблиц', 'i')
            AND NOT EXISTS (SELECT 1 FROM caps c WHERE c.doc_id = z.doc_id AND c.idx = z.idx AND c.kind <> 'listing'))))"""
CTES["num_map"] = """
    SELECT doc_id, kind, original_number AS num, arg_max(new_number, idx) AS mapped FROM caps
    WHERE original_number IS NOT NULL AND kind <> 'listing' GROUP BY doc_id, kind, original_number"""
CTES["valid"] = "SELECT DISTINCT doc_id, kind, new_number FROM caps WHERE kind <> 'listing'"
CTES["resolved_all"] = """
    SELECT r.*, CASE WHEN m.mapped IS NOT NULL THEN m.mapped WHEN v.new_number IS NOT NULL THEN r.num
      WHEN NOT contains(r.num, '.') THEN CAST(TRY_CAST(r.num AS BIGINT) AS VARCHAR) WHEN h.new_number IS NOT NULL THEN h.new_number END AS resolved
    FROM refs r LEFT JOIN num_map m ON r.doc_id = m.doc_id AND r.kind = m.kind AND r.num = m.num
      LEFT JOIN valid v ON r.doc_id = v.doc_id AND r.kind = v.kind AND r.num = v.new_number
      LEFT JOIN valid h ON r.doc_id = h.doc_id AND r.kind = h.kind AND CAST(TRY_CAST(string_split(r.num, '.')[1] AS BIGINT) AS VARCHAR) = h.new_number"""
CTES["resolved"] = """
    SELECT doc_id, kind, resolved, idx, phrase FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, resolved ORDER BY idx, span_no, num_no) AS rn
      FROM resolved_all WHERE resolved IS NOT NULL) WHERE rn = 1"""
CTES["spots"] = f"""
    SELECT doc_id, section, coalesce(min(pos) FILTER (src = 1), min(pos) FILTER (src = 2), min(pos) FILTER (src = 3)) AS pos FROM (
      SELECT p.doc_id, a.section, 1 AS src, p.rk AS pos FROM (SELECT doc_id, norm, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS rk
        FROM zone WHERE NOT in_title AND NOT is_empty) p JOIN section_names a ON p.norm = a.alias
      UNION ALL SELECT h.doc_id, a.section, 2, h.rk FROM (SELECT doc_id, title_norm, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS rk
        FROM head_title) h JOIN section_names a ON h.title_norm = a.alias
      UNION ALL SELECT doc_id, 'contents', 3, -1 FROM documents WHERE doc_id % 4 = 3) GROUP BY doc_id, section"""
CTES = {
    "section_names": "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{s}', '{a}', {c}, '{n}')" for s, a, c, n in ru.alias_rows(RULES)
    )
    + ") t(section, alias, is_canonical, canonical)",
    "forbidden_names": "SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in ru.forbidden_rows(RULES))
    + ") t(key_norm, replacement)",
    **CTES,
}
CTES["spots"] = CTES["spots"].replace("JOIN section_names a", "JOIN (SELECT * FROM section_names WHERE section NOT IN ('title_page', 'task')) a")
CTES["table_rows"] = """
    SELECT *, CASE WHEN row_no % 5 = 4 OR (doc_id % 10 = 9 AND row_no < 2) THEN NULL ELSE CAST(9 + floor(row_no / 12) AS INT) END AS page FROM (
      SELECT l_partkey AS doc_id, 0 AS tbl_no, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS row_no,
        CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) AS cell_1, concat(l_returnflag, l_linestatus) AS cell_2, 2 AS total_runs,
        CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 1 END AS bold_runs FROM lineitem)"""
CTES["table_cells"] = """
    SELECT doc_id, tbl_no, row_no, 0 AS col_no, CASE WHEN doc_id % 7 = 3 THEN '____' ELSE cell_1 END AS text FROM table_rows
    UNION ALL SELECT doc_id, tbl_no, row_no, 1, CASE WHEN doc_id % 7 = 3 THEN '____' ELSE cell_2 END FROM table_rows"""
CTES["table_pairs"] = """
    SELECT p_partkey AS doc_id, 0 AS tbl_no, 0 AS caption_idx, CAST(1 + p_partkey % 9 AS VARCHAR) AS number, p_name AS title FROM part WHERE p_partkey % 11 <> 0"""
CTES["page_rows"] = """
    SELECT *, max(page) OVER (PARTITION BY doc_id, tbl_no ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS on_page FROM table_rows WHERE row_no > 0"""
CTES["page_groups"] = """
    SELECT doc_id, tbl_no, on_page, n AS rows, row_number() OVER (PARTITION BY doc_id, tbl_no ORDER BY on_page) AS part FROM (
      SELECT doc_id, tbl_no, on_page, count(*) AS n, count(*) OVER (PARTITION BY doc_id, tbl_no) AS groups,
        bool_or(on_page IS NULL) OVER (PARTITION BY doc_id, tbl_no) AS unknown FROM page_rows GROUP BY doc_id, tbl_no, on_page)
    WHERE NOT unknown AND groups > 1"""
CTES["submissions"] = """
    SELECT o_orderkey AS doc_id, o_custkey AS user_id, CAST(o_orderdate AS TIMESTAMP) AS uploaded_at, concat('thesis_', o_orderkey, '.docx') AS original_filename,
      CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'processing' ELSE 'error' END AS status,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'pending_review' WHEN '2-HIGH' THEN 'approved' WHEN '3-MEDIUM' THEN 'rejected' END AS approval_status,
      CAST(o_orderdate AS TIMESTAMP) + INTERVAL '90' DAY AS expires_at, 1 + o_orderkey % 3 AS version_id FROM orders"""
CTES["people"] = """
    SELECT c_custkey AS user_id, c_name AS full_name, concat('u', c_custkey, '@mail.test') AS email, 'student' AS role,
      CASE WHEN c_custkey % 12 = 11 THEN NULL ELSE 1000000 + c_custkey % 10 END AS supervisor_id FROM customer
    UNION ALL SELECT 1000000 + s_suppkey, s_name, concat('s', s_suppkey, '@mail.test'), CASE WHEN s_suppkey % 10 = 9 THEN 'dean' ELSE 'supervisor' END, NULL FROM supplier"""
CTES["found"] = """
    SELECT md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(trunc(l_quantity) AS INT), strftime(l_shipdate, '%Y-%m-%d'))) AS finding_id,
      l_orderkey AS doc_id, CASE l_partkey % 6 WHEN 0 THEN 'heading_number_conflict' WHEN 1 THEN 'heading_confirm' WHEN 2 THEN 'citation_without_source'
        WHEN 3 THEN 'caption_renumbered' WHEN 4 THEN 'volume_below_minimum' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'forbidden_heading' ELSE 'unknown_type' END END AS type,
      CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity,
      CASE WHEN l_linestatus = 'O' THEN 'manual_required' WHEN l_suppkey % 3 = 0 THEN 'accepted' WHEN l_suppkey % 3 = 1 AND l_partkey % 5 = 0 THEN 'rejected' ELSE 'auto_fixed' END AS status,
      CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_partkey % 200 END AS paragraph_index, concat('section ', l_partkey % 50) AS section_title,
      CASE WHEN l_partkey % 4 = 0 THEN concat(1 + l_partkey % 3, '.', l_linenumber) ELSE CAST(1 + l_partkey % 3 AS VARCHAR) END AS original_text,
      CASE WHEN l_partkey % 3 = 0 THEN concat('fixed ', l_linenumber) END AS fixed_text,
      CASE WHEN l_linenumber > 1 AND l_suppkey % 2 = 0 THEN l_partkey % 200 - l_linenumber END AS caused_by_index FROM lineitem"""
CTES["notes"] = """
    SELECT 1 + conv_id AS doc_id, turn, role AS author_role, text AS body, TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL '1' HOUR AS created_at FROM conversations"""
CTES["verdicts"] = """
    SELECT event_id, user_id AS doc_id, CAST(ts AS TIMESTAMP) AS decided_at, CASE event_type WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'approve'
      WHEN 'error' THEN 'reject' ELSE 'comment' END AS action, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('note ', event_id) END AS comment FROM events"""
CTES["heading_eval"] = """
    SELECT doc_id, idx, CASE WHEN idx % 10 = 1 THEN 1 + doc_id % 3 END AS gold_level,
      CASE WHEN idx % 10 = 1 AND (doc_id + idx) % 6 <> 0 THEN 1 + (doc_id + CASE WHEN idx % 20 = 1 THEN 0 ELSE doc_id % 2 END) % 3
        WHEN (doc_id * 3 + idx) % 41 = 0 THEN 2 END AS pred_level FROM para_text"""
CTES["timing"] = "SELECT user_id AS file_id, event_id % 3 AS run_no, event_type AS step, value AS duration_ms, event_id AS seq FROM events"


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with every common table expression it needs, in order."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name, body in CTES.items():
            if name not in needed and re.search(rf"(?:FROM|JOIN|IN)\s+\(?{name}\b|,\s*{name}\s", text):
                needed.add(name)
                pending.append(body)
    parts = [f"{name} AS MATERIALIZED ({body})" for name, body in _ordered(needed)]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


def _ordered(needed: set[str]) -> list[tuple[str, str]]:
    done: list[tuple[str, str]] = []
    left = {n: CTES[n] for n in needed}
    while left:
        for name, body in list(left.items()):
            if not any(o != name and re.search(rf"(?:FROM|JOIN)\s+\(?{o}\b", body) for o in left):
                done.append((name, left.pop(name)))
                break
        else:
            raise ValueError(f"circular expressions: {sorted(left)}")
    return done
