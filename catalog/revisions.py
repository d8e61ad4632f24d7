"""Text revision and whole reports."""

from pyspark.sql import functions as F

from catalog.core import FINDING, RULES, query
from catalog.rules_checks import ABOVE
from galley.operators import body
from galley.operators import revision as rv
from galley.plans import reports
from oracle.base import CHAPTER, NOTWORD, WS, norm, strip

_CAPITAL = " OR ".join(f"starts_with(n, '{k}')" for k in rv.CAPITAL_TITLES)
_UPPER = "regexp_matches({0}, '\\p{{Lu}}') AND NOT regexp_matches({0}, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]')"


def _case(words: str) -> str:
    return (
        f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN i = 1 THEN concat(upper(w[1]), lower(w[2:])) "
        f"WHEN length(w) = 1 AND regexp_matches(w, '\\p{{L}}') AND lower({words}[i - 1]) IN ('приложение', 'часть', 'раздел') THEN upper(w) ELSE lower(w) END), ' ')"
    )


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


_BARE = "CASE WHEN pk = 'chapter_word' THEN CASE WHEN ptitle <> '' THEN concat(pnum, ' ', ptitle) ELSE pnum END ELSE {} END"
_NORMALISED = f"""
    SELECT doc_id, idx, CASE WHEN regexp_matches(flat, '^\\s*приложение{NOTWORD}', 'i') THEN {_case(_words('flat'))}
      WHEN {_CAPITAL} THEN upper(flat)
      ELSE concat(lead, CASE WHEN rest = '' OR NOT regexp_matches(rest, '\\p{{L}}') THEN rest WHEN {_UPPER.format('rest')} THEN {_case(_words('rest'))}
        WHEN regexp_matches(rest, '^\\p{{Ll}}') THEN concat(upper(rest[1]), rest[2:]) ELSE rest END) END AS new_text
    FROM (SELECT *, substr(flat, length(lead) + 1) AS rest, {norm('flat')} AS n FROM (SELECT *, regexp_extract(flat, '^([\\d.]+\\s+)', 1) AS lead FROM (
      SELECT *, regexp_replace(regexp_replace(regexp_replace(plain, '^(\\d+(?:\\.\\d+)*)[.)]?[{WS}]+', '\\1 '), '[{WS}]+', ' ', 'g'), '\\.+$', '') AS flat FROM (
        SELECT *, {_BARE.format(f"regexp_replace(text, '^[{WS}]+', '')")} AS plain FROM %s))))"""


@query("X1_normalise_heading_text", "doc_id:l idx:l new_text:s", _NORMALISED % "(SELECT * REPLACE (stripped AS text) FROM heads)")
def _(f):
    return rv.normalise_headings(f.headings)


@query("X2_normalise_spaces", "doc_id:l idx:l new_text:s", """
    SELECT doc_id, idx, trim(regexp_replace(text, ' {2,}', ' ', 'g')) AS new_text FROM zone z WHERE NOT in_title AND text <> trim(regexp_replace(text, ' {2,}', ' ', 'g'))
      AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = z.doc_id AND h.idx = z.idx) AND NOT EXISTS (SELECT 1 FROM code_lines c WHERE c.doc_id = z.doc_id AND c.idx = z.idx)""")
def _(f):
    from galley.operators.zones import listing_code_lines
    return rv.space_changes(f.zoned, f.headings, listing_code_lines(f.zoned))


@query("X3_strip_chapter_word", "doc_id:l idx:l new_text:s", f"""
    SELECT doc_id, idx, {_BARE.format('stripped')} AS new_text FROM zone WHERE NOT in_title AND length <= 140 AND pk = 'chapter_word'""")
def _(f):
    return rv.chapter_word_changes(f.zoned)


@query("X4_drop_empty_paragraphs", "doc_id:l idx:l old_idx:l text:s", """
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS idx, idx AS old_idx, text FROM (
      SELECT *, coalesce(lag(table_follows) OVER (PARTITION BY doc_id ORDER BY idx), false) AS after_table FROM zone)
    WHERE in_title OR NOT is_empty OR has_image OR after_table""")
def _(f):
    return rv.drop_empty_paragraphs(f.zoned)


@query("X5_toc_outline", "doc_id:l idx:l level:l text:s", """
    SELECT doc_id, idx, outline_level + 1 AS level, stripped AS text FROM zone
    WHERE NOT in_title AND NOT is_empty AND outline_level BETWEEN 0 AND 2 AND norm NOT IN ('содержание', 'оглавление')""")
def _(f):
    return rv.toc_outline(f.zoned, RULES)


def _outline(f):
    return f.headings.select("doc_id", "idx", "text")


_SQUASH = "trim(regexp_replace(lower(coalesce({}, '')), '[^0-9a-zа-яё]+', ' ', 'g'))"
# One recursion step takes the next matched entry of every manuscript and keeps the page that it has reached.
_HEADING_PAGES = f"""
    WITH RECURSIVE page_texts AS (
      SELECT doc_id, idx // 12 + 1 AS page_no, concat(string_agg(text, chr(10) ORDER BY idx), chr(10), idx // 12 + 1 + doc_id % 3) AS page_text
      FROM paras GROUP BY doc_id, idx // 12),
    page_lines AS (SELECT doc_id, page_no, line, {_SQUASH.format('line')} AS sq, line_no FROM (
      SELECT doc_id, page_no, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_no FROM (
        SELECT *, string_split_regex(page_text, '\r?\n') AS parts FROM page_texts))),
    page_info AS (
      SELECT doc_id, page_no, coalesce(regexp_matches(min_by(sq, line_no) FILTER (sq <> ''), '^(содержание|оглавление)'), false) AS is_contents,
        max_by(TRY_CAST(regexp_extract(line, '^\\s*(\\d{{1,4}})\\s*$', 1) AS BIGINT), line_no) FILTER (regexp_matches(line, '^\\s*\\d{{1,4}}\\s*$')) AS footer
      FROM page_lines GROUP BY doc_id, page_no),
    wanted_heads AS (SELECT doc_id, idx, {_SQUASH.format('text')} AS sq FROM heads
      WHERE {_SQUASH.format('text')} <> '' AND doc_id IN (SELECT doc_id FROM page_info GROUP BY doc_id HAVING count(*) > 1)),
    hits AS (
      SELECT e.doc_id, e.idx, list(DISTINCT l.page_no ORDER BY l.page_no) AS pages, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.idx) AS n
      FROM wanted_heads e JOIN page_lines l ON l.doc_id = e.doc_id AND l.sq <> '' AND (starts_with(l.sq, e.sq)
        OR (length(l.sq) >= 12 AND starts_with(e.sq, l.sq)) OR (contains(l.sq, e.sq) AND length(l.sq) <= length(e.sq) + 12)
        OR (length(e.sq) > 40 AND starts_with(l.sq, e.sq[:40])) OR (length(e.sq) > 30 AND starts_with(l.sq, e.sq[:30]))
        OR (length(e.sq) > 20 AND starts_with(l.sq, e.sq[:20])))
      JOIN page_info i ON i.doc_id = l.doc_id AND i.page_no = l.page_no AND NOT i.is_contents GROUP BY e.doc_id, e.idx),
    walked AS (
      SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS idx, CAST(NULL AS BIGINT) AS page_no, CAST(0 AS BIGINT) AS reached FROM hits
      UNION ALL
      SELECT w.doc_id, h.n, h.idx, list_min(list_filter(h.pages, lambda p: p >= w.reached)),
        coalesce(list_min(list_filter(h.pages, lambda p: p >= w.reached)), w.reached) FROM walked w JOIN hits h ON h.doc_id = w.doc_id AND h.n = w.n + 1),
    shifts AS (
      SELECT doc_id, arg_max(shift, (k, -first_idx)) AS shift FROM (
        SELECT w.doc_id, i.footer - i.page_no AS shift, count(*) AS k, min(w.idx) AS first_idx
        FROM walked w JOIN page_info i ON i.doc_id = w.doc_id AND i.page_no = w.page_no WHERE i.footer IS NOT NULL GROUP BY w.doc_id, i.footer - i.page_no)
      GROUP BY doc_id),
    printed AS (
      SELECT w.doc_id, w.idx, max(greatest(w.page_no + coalesce(s.shift, 0), 1)) OVER (PARTITION BY w.doc_id ORDER BY w.idx) AS page
      FROM walked w LEFT JOIN shifts s ON s.doc_id = w.doc_id WHERE w.page_no IS NOT NULL)
    SELECT h.doc_id, h.idx, p.page FROM heads h LEFT JOIN printed p ON p.doc_id = h.doc_id AND p.idx = h.idx"""


@query("X6_heading_pages", "doc_id:l idx:l page:l", _HEADING_PAGES)
def _(f):
    return rv.heading_pages(f.pages, _outline(f))


_PLACED = "SELECT doc_id, idx, idx // 12 + {} AS page FROM heads"


@query("X7_page_numbers_changed", "doc_id:l changed:l", """
    SELECT doc_id, count(*) AS changed FROM (SELECT doc_id, idx // 12 + 1 AS a, (idx + doc_id % 3) // 12 + 1 AS b FROM heads) WHERE a <> b GROUP BY doc_id""")
def _(f):
    before = f.headings.select("doc_id", "idx", F.floor(F.col("idx") / 12).cast("int").alias("page"))
    after = f.headings.select("doc_id", "idx", F.floor((F.col("idx") + F.col("doc_id") % 3) / 12).cast("int").alias("page"))
    return rv.page_numbers_changed(before, after)


# The longest block of equal lines splits every region, one recursion step for all regions of all documents. Of versions
# with 200 lines or more, lines that are more than a hundredth of the new one only lengthen blocks that others begin.
_DIFF = """
    WITH RECURSIVE old_lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS i, text FROM paras),
    new_lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS j, text FROM (
      SELECT doc_id, idx * 4 + CASE WHEN idx % 31 = 7 THEN 18 ELSE 0 END AS k, CASE WHEN idx % 9 = 4 THEN lower(text) ELSE text END AS text
      FROM paras WHERE (doc_id + idx) % 23 <> 0
      UNION ALL SELECT doc_id, idx * 4 + 1, concat('Вставка ', idx % 5) FROM paras WHERE idx % 17 = 3)),
    lengths AS (SELECT doc_id, n_a, n_b FROM (SELECT doc_id, count(*) AS n_a FROM old_lines GROUP BY doc_id)
      JOIN (SELECT doc_id, count(*) AS n_b FROM new_lines GROUP BY doc_id) USING (doc_id)),
    popular AS (SELECT doc_id, text FROM new_lines JOIN lengths USING (doc_id) WHERE n_b >= 200 GROUP BY doc_id, text, n_b HAVING count(*) > n_b // 100 + 1),
    pairs AS (SELECT a.doc_id, a.i, b.j, p.text IS NOT NULL AS pop FROM old_lines a JOIN new_lines b ON a.doc_id = b.doc_id AND a.text = b.text
      LEFT JOIN popular p ON p.doc_id = b.doc_id AND p.text = b.text),
    walk AS (
      SELECT doc_id, CAST(0 AS BIGINT) AS alo, n_a AS ahi, CAST(0 AS BIGINT) AS blo, n_b AS bhi, false AS is_block FROM lengths
      UNION ALL
      SELECT doc_id, c.alo, c.ahi, c.blo, c.bhi, c.is_block FROM (
        SELECT doc_id, unnest([{'alo': b.lo, 'ahi': b.hi + 1, 'blo': b.lo - b.d, 'bhi': b.hi + 1 - b.d, 'is_block': true},
          {'alo': alo, 'ahi': b.lo, 'blo': blo, 'bhi': b.lo - b.d, 'is_block': false},
          {'alo': b.hi + 1, 'ahi': ahi, 'blo': b.hi + 1 - b.d, 'bhi': bhi, 'is_block': false}]) AS c
        FROM (SELECT doc_id, alo, ahi, blo, bhi, arg_max({'lo': lo, 'hi': hi, 'd': d}, (size, -i, -j)) AS b FROM (
          SELECT doc_id, alo, ahi, blo, bhi, d, lo, hi, CASE WHEN pop THEN 0 ELSE count(*) END AS size, min(i) AS i, min(j) AS j FROM (
            SELECT *, min(i) OVER (PARTITION BY doc_id, alo, blo, d, run) AS lo, max(i) OVER (PARTITION BY doc_id, alo, blo, d, run) AS hi FROM (
              SELECT w.doc_id, w.alo, w.ahi, w.blo, w.bhi, p.i, p.j, p.pop, p.i - p.j AS d,
                p.i - row_number() OVER (PARTITION BY w.doc_id, w.alo, w.blo, p.i - p.j ORDER BY p.i) AS run,
                p.i - row_number() OVER (PARTITION BY w.doc_id, w.alo, w.blo, p.i - p.j, p.pop ORDER BY p.i) AS sub
              FROM walk w JOIN pairs p ON p.doc_id = w.doc_id AND p.i >= w.alo AND p.i < w.ahi AND p.j >= w.blo AND p.j < w.bhi WHERE NOT w.is_block))
          WHERE NOT pop OR (i = alo AND j = blo) GROUP BY doc_id, alo, ahi, blo, bhi, d, lo, hi, pop, sub)
        GROUP BY doc_id, alo, ahi, blo, bhi))
      WHERE c.is_block OR (c.alo < c.ahi AND c.blo < c.bhi)),
    matched AS (SELECT doc_id, unnest(range(alo, ahi)) AS i, unnest(range(blo, bhi)) AS j FROM walk WHERE is_block),
    script AS (
      SELECT doc_id, i + j AS place, ' ' AS op, i AS old_no, j AS new_no, text FROM matched JOIN old_lines USING (doc_id, i)
      UNION ALL
      SELECT doc_id, i + coalesce(max(mj) OVER (PARTITION BY doc_id ORDER BY i) + 1, 0), '-', i, NULL, text FROM (
        SELECT o.*, m.j AS mj FROM old_lines o LEFT JOIN matched m ON m.doc_id = o.doc_id AND m.i = o.i) QUALIFY mj IS NULL
      UNION ALL
      SELECT doc_id, j + coalesce(min(mi) OVER (PARTITION BY doc_id ORDER BY j DESC), n_a), '+', NULL, j, text FROM (
        SELECT n.*, m.i AS mi FROM new_lines n LEFT JOIN matched m ON m.doc_id = n.doc_id AND m.j = n.j) JOIN lengths USING (doc_id) QUALIFY mi IS NULL),
    near_lines AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS ln,
        bool_or(op <> ' ') OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS is_near FROM script),
    opened AS (SELECT *, CASE WHEN ln - coalesce(lag(ln) OVER (PARTITION BY doc_id ORDER BY ln), -9) > 1 THEN 1 ELSE 0 END AS opens FROM near_lines WHERE is_near)
    SELECT doc_id, sum(opens) OVER (PARTITION BY doc_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS hunk, place, old_no, new_no, op, text FROM opened"""


@query("X8_revision_diff", "doc_id:l hunk:l place:l old_no:l new_no:l op:s text:s", _DIFF)
def _(f):
    old = f.paragraphs.select("doc_id", "idx", "text")
    quiet = F.when(F.col("idx") % 9 == 4, F.lower("text")).otherwise(F.col("text"))
    moved = F.col("idx") * 4 + F.when(F.col("idx") % 31 == 7, 18).otherwise(0)
    kept = old.where("(doc_id + idx) % 23 <> 0").select("doc_id", moved.alias("idx"), quiet.alias("text"))
    added = old.where("idx % 17 = 3").select("doc_id", (F.col("idx") * 4 + 1).alias("idx"), F.concat(F.lit("Вставка "), F.col("idx") % 5).alias("text"))
    return rv.revision_diff(old, kept.unionByName(added))


def _whole(f):
    """Manuscripts with their tables; the runs of a row count with its first cell."""
    cells = f.rows_of_tables.selectExpr(
        "doc_id", "tbl_no", "row_no",
        "inline(array(struct(0 AS col_no, cell_1 AS text, total_runs, bold_runs), struct(1 AS col_no, cell_2 AS text, 0 AS total_runs, 0 AS bold_runs)))",
    )
    return reports.Manuscripts(f.paragraphs, cells, f.hidden_texts, f.table_pairs)


@query("X9_check_report", FINDING)
def _(f):
    return reports.check_report(_whole(f), RULES, f.found)


@query("X9_revise_findings", FINDING)
def _(f):
    return reports.revise(_whole(f), RULES).findings


_ROW = "PARTITION BY doc_id ORDER BY new_pos ROWS BETWEEN"
_PLACED = f"""
    SELECT doc_id, CAST(idx AS INT) AS idx, CAST(elem_no AS INT) AS elem_no, text, table_follows, next_is_table, added FROM (
      SELECT doc_id, kind, text, added, count(*) OVER ({_ROW} UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS elem_no,
        count(*) FILTER (kind = 'p') OVER ({_ROW} UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS idx,
        coalesce(lead(kind) OVER (PARTITION BY doc_id ORDER BY new_pos) = 'tbl', false) AS table_follows,
        coalesce(first_value(CASE WHEN kind = 'tbl' OR trim(text) <> '' THEN kind END IGNORE NULLS) OVER ({_ROW} 1 FOLLOWING AND UNBOUNDED FOLLOWING) = 'tbl', false) AS next_is_table
      FROM (%s)) WHERE kind = 'p'"""
_PLACED_COLUMNS = "doc_id:l idx:l elem_no:l text:s table_follows:b next_is_table:b added:b"
_BLANKED = """
    WITH e AS (SELECT doc_id, elem_no, 'p' AS kind, text, in_title AND NOT is_empty AS quiet, trim(text) = '' AND NOT coalesce(in_title AND NOT is_empty, false) AS blank FROM zone
      UNION ALL SELECT doc_id, elem_no + 1, 'tbl', NULL, false, false FROM zone WHERE table_follows),
    n AS (SELECT *, coalesce(lead(blank) OVER (PARTITION BY doc_id ORDER BY elem_no), false) AS blank_next FROM e),
    a AS (SELECT *, (kind = 'tbl' OR (NOT quiet AND regexp_matches(text, '^\\s*рисунок\\s+\\d+(\\.\\d+)*\\s*[–—\\-]\\s*\\S', 'i'))) AND NOT blank_next AS needs FROM n)
    SELECT doc_id, elem_no * 2 AS new_pos, kind, text, false AS added FROM a UNION ALL SELECT doc_id, elem_no * 2 + 1, 'p', '', true FROM a WHERE needs"""


@query("X9_captions_above", _PLACED_COLUMNS, _PLACED % f"""
    SELECT k.*, k.moved AND k.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM paras p WHERE p.doc_id = k.doc_id AND p.elem_no = k.elem_no) AS added FROM ({ABOVE}) k""")
def _(f):
    tables = f.paragraphs.where("table_follows")
    text = F.when(F.col("doc_id") % 6 == 4, F.lit("\n Таблица 1 — Итоги")).otherwise(F.lit("Показатель"))
    cells = tables.select("doc_id", (F.col("elem_no") + 1).alias("elem_no"), F.lit(0).alias("row_no"), F.lit(0).alias("col_no"), text.alias("text"))
    placed = body.with_captions_above(f.paragraphs.withColumn("given_idx", F.col("idx")), cells)[0]
    return placed.withColumn("added", F.col("given_idx").isNull())


@query("X9_blanks_after", _PLACED_COLUMNS, _PLACED % _BLANKED)
def _(f):
    tables = f.body_elements.where("kind = 'tbl'").select("doc_id", "elem_no")
    return body.with_blanks_after(f.zoned.withColumn("given_idx", F.col("idx")), tables).withColumn("added", F.col("given_idx").isNull())


@query("X10_appendix_title_rows", "doc_id:l label_idx:l idx:l new_text:s", f"""
    SELECT doc_id, idx AS label_idx, CASE WHEN mark THEN i2 ELSE i1 END AS idx,
      CASE WHEN regexp_matches(t, '^\\p{{Ll}}') THEN concat(upper(t[1]), t[2:]) ELSE t END AS new_text FROM (
      SELECT *, CASE WHEN mark THEN t2 ELSE t1 END AS t, {norm('CASE WHEN mark THEN t2 ELSE t1 END')} AS n FROM (
        SELECT *, coalesce(regexp_matches(t1, '^\\s*\\(?\\s*(обязательн|справочн|рекомендуем|информацион)', 'i'), false) AS mark FROM (
          SELECT *, lead(idx) OVER w AS i1, lead(stripped) OVER w AS t1, lead(idx, 2) OVER w AS i2, lead(stripped, 2) OVER w AS t2 FROM zone WHERE NOT is_empty
          WINDOW w AS (PARTITION BY doc_id ORDER BY idx)))
      WHERE regexp_matches(stripped, '^\\s*приложение{NOTWORD}', 'i') AND length(stripped) < 40) WHERE t IS NOT NULL AND NOT ({_CAPITAL})""")
def _(f):
    return rv.appendix_title_rows(f.zoned)


def _edits(f):
    # Two edits of every seventh paragraph, and some far behind the end of the manuscript.
    rows = f.paragraphs.select("doc_id", "idx").where("(doc_id + idx) % 7 = 0")
    return rows.select(
        "doc_id", F.expr("CASE WHEN (doc_id + idx) % 14 = 0 THEN idx ELSE idx + 1000000000 END").alias("idx"),
        F.explode(F.array(F.struct(F.lit(1).alias("edited_at"), F.lit("old").alias("new_text")),
                          F.struct(F.lit(2).alias("edited_at"), F.expr("concat(' edit ', idx, ' ')").alias("new_text")))).alias("e"),
    ).select("doc_id", "idx", "e.*")


@query("X11_apply_paragraph_edits", "doc_id:l idx:l text:s", """
    SELECT doc_id, idx, CASE WHEN (doc_id + idx) % 14 = 0 THEN concat('edit ', idx) ELSE text END AS text FROM paras""")
def _(f):
    return rv.apply_paragraph_edits(f.paragraphs.select("doc_id", "idx", "text"), _edits(f))[0]


@query("X11_rejected_edits", "doc_id:l idx:l edited_at:l", """
    SELECT doc_id, idx + 1000000000 AS idx, unnest([1, 2]) AS edited_at FROM paras WHERE (doc_id + idx) % 14 = 7""")
def _(f):
    return rv.apply_paragraph_edits(f.paragraphs.select("doc_id", "idx", "text"), _edits(f))[1]


@query("X12_replace_heading_number", "doc_id:l idx:l new_text:s", f"""
    SELECT doc_id, idx, CASE WHEN regexp_matches(text, '^\\d+(\\.\\d+)*[.)]?\\s+') THEN regexp_replace(text, '^\\d+(\\.\\d+)*[.)]?\\s+', '7.1 ')
      WHEN regexp_matches(text, '^(?:{CHAPTER})\\s+(?:\\d+(?:\\.\\d+)*|[ivxlcdm]+)[.:\\s]+', 'i') THEN regexp_replace(text, '^(?:{CHAPTER})\\s+(?:\\d+(?:\\.\\d+)*|[ivxlcdm]+)[.:\\s]+', '7.1 ', 'i')
      WHEN starts_with(text, 'ВВ') THEN concat('7.1 ', substr(text, 3)) END AS new_text FROM (SELECT doc_id, idx, stripped AS text FROM heads)""")
def _(f):
    new = rv.replace_heading_number(F.col("text"), F.lit("7.1."), F.lit("ВВ"))
    return f.headings.select("doc_id", "idx", new.alias("new_text"))


@query("X13_promote_heading", "doc_id:l idx:l level:l new_text:s", f"""
    SELECT doc_id, idx, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS level,
      CASE WHEN doc_id % 3 = 0 THEN new_text ELSE rtrim(concat('2.', idx, ' ', ltrim(regexp_replace(new_text, '^\\s*\\d+(?:\\.\\d+){{0,2}}[.)]?\\s+', '')))) END AS new_text
    FROM ({_NORMALISED % "(SELECT * FROM scored WHERE tier = 'medium')"})""")
def _(f):
    actions = f.scored.where("tier = 'medium'").select(
        "doc_id", "idx", F.expr("CASE WHEN doc_id % 3 <> 0 THEN concat('2.', idx) END").alias("chosen_number"),
        F.lit(None).cast("int").alias("level"),
    )
    return rv.promote_headings(f.zoned, actions)


def _demoted(f):
    return f.headings.where("(doc_id + idx) % 5 = 0").select(
        "doc_id", "idx", F.expr("CASE WHEN idx % 2 = 0 THEN 'list' ELSE 'text' END").alias("as_kind")
    )


@query("X14_demote_heading", "doc_id:l idx:l new_text:s", """
    SELECT doc_id, idx, CASE WHEN d = '' THEN text WHEN rest = '' THEN concat(d, '.') ELSE concat(d, '. ', ltrim(rest)) END AS new_text FROM (
      SELECT doc_id, idx, text, regexp_extract(text, '^(\\d+(?:\\.\\d+){0,2})[.)]?\\s*', 1) AS d, regexp_replace(text, '^(\\d+(?:\\.\\d+){0,2})[.)]?\\s*', '') AS rest
      FROM heads WHERE (doc_id + idx) % 5 = 0 AND idx % 2 = 0)""")
def _(f):
    return rv.demote_headings(f.features, f.headings, _demoted(f))[1]


@query("X14_headings_left", "doc_id:l idx:l", "SELECT doc_id, idx FROM heads WHERE (doc_id + idx) % 5 <> 0")
def _(f):
    return rv.demote_headings(f.zoned, f.headings, _demoted(f))[0]


@query("X15_revert_caption", "doc_id:l idx:l new_text:s", """
    SELECT doc_id, min(idx) AS idx, 'was here' AS new_text FROM zone WHERE stripped = 'ЗАКЛЮЧЕНИЕ' AND doc_id % 2 = 0 GROUP BY doc_id""")
def _(f):
    reverted = f.docs.where("doc_id % 2 = 0").select(
        F.col("doc_id").alias("finding_id"), "doc_id", F.lit("was here ").alias("original_text"), F.lit(" ЗАКЛЮЧЕНИЕ").alias("fixed_text")
    )
    return rv.revert_captions(f.paragraphs, reverted)[0]


@query("X16_revert_auto_fix", "doc_id:l idx:l text:s max_font_size_pt:d space_after_pt:d style_name:s", """
    SELECT doc_id, idx, CASE WHEN doc_id % 4 = 1 AND idx = 2 THEN text WHEN doc_id % 4 = 0 AND idx = 1 THEN 'Старое' ELSE lower(text) END AS text,
      CASE WHEN doc_id % 4 = 3 AND idx < 8 THEN max_font_size_pt ELSE 14 END AS max_font_size_pt, CASE WHEN doc_id % 4 = 2 AND idx < 8 THEN space_after_pt ELSE 0 END AS space_after_pt,
      CASE WHEN doc_id % 4 = 1 AND idx = 3 THEN 'Normal' ELSE 'Heading 1' END AS style_name FROM paras""")
def _(f):
    original = f.paragraphs.where("idx < 8").withColumn("space_before_pt", F.lit(0.0))
    revised = f.paragraphs.select("doc_id", "idx", F.lower("text").alias("text"), F.lit(14.0).alias("max_font_size_pt"), F.lit(0.0).alias("space_before_pt"),
                                  F.lit(0.0).alias("space_after_pt"), F.lit("Heading 1").alias("style_name"), "outline_level")
    kinds = F.expr("""CASE doc_id % 4 WHEN 0 THEN array(struct('forbidden_heading' AS type, 1 AS paragraph_index, 'Старое ' AS original_text))
        WHEN 1 THEN array(struct('citation_separator_missing' AS type, 2 AS paragraph_index, '' AS original_text), struct('heading_recovered' AS type, 3 AS paragraph_index, '' AS original_text))
        WHEN 2 THEN array(struct('paragraph_spacing' AS type, CAST(NULL AS INT) AS paragraph_index, '' AS original_text))
        ELSE array(struct('font_size_inconsistency' AS type, CAST(NULL AS INT) AS paragraph_index, '' AS original_text)) END""")
    return rv.revert_auto_fixes(revised, original, f.docs.select("doc_id", F.inline(kinds)))


@query("X17_keep_list_number", "doc_id:l idx:l new_text:s", """
    SELECT z.doc_id, z.idx, concat(a.auto_number, '. ', ltrim(text)) AS new_text FROM zone z JOIN list_numbers a ON z.doc_id = a.doc_id AND z.idx = a.idx
    WHERE NOT in_title AND NOT is_empty AND NOT regexp_matches(text, '^\\s*\\d') AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = z.doc_id AND h.idx = z.idx)""")
def _(f):
    return rv.keep_list_numbers(f.scored, f.headings)


@query("X18_one_blank_after_blocks", "doc_id:l elem_no:l kind:s text:s added:b new_pos:l", """
    WITH e AS (SELECT doc_id, elem_no, 'p' AS kind, text FROM paras UNION ALL SELECT doc_id, elem_no + 1, 'tbl', NULL FROM paras WHERE table_follows),
    n AS (SELECT *, coalesce(lead(kind = 'p' AND trim(text) = '') OVER (PARTITION BY doc_id ORDER BY elem_no), false) AS blank_next FROM e),
    a AS (SELECT *, (kind = 'tbl' OR regexp_matches(text, '^\\s*рисунок\\s+\\d+(\\.\\d+)*\\s*[–—\\-]\\s*\\S', 'i')) AND NOT blank_next AS needs FROM n),
    x AS (SELECT doc_id, elem_no, kind, text, false AS added FROM a UNION ALL SELECT doc_id, elem_no, 'p', '', true FROM a WHERE needs)
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY elem_no, added) - 1 AS new_pos FROM x""")
def _(f):
    return rv.one_blank_after_blocks(f.body_elements)


@query("X19_page_break_plan", "doc_id:l idx:l", f"""
    SELECT h.doc_id, h.idx FROM heads h JOIN zone b ON b.doc_id = h.doc_id AND b.idx = h.idx - 1
    WHERE h.level = 1 AND NOT b.table_follows AND NOT b.has_page_break_before AND NOT regexp_matches(b.stripped, '^\\s*приложение{NOTWORD}', 'i')
      AND NOT regexp_matches(b.stripped, '^\\s*\\(?\\s*(обязательн|справочн|рекомендуем|информацион)', 'i')""")
def _(f):
    return rv.page_break_plan(f.zoned, f.headings)
