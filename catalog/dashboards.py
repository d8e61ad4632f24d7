"""Dashboards, reports and quality measures."""

from pyspark.sql import functions as F

from catalog.core import query
from galley.operators import citations, dashboard as db, quality as ql
from galley.operators.labels import TYPE_CATEGORIES, TYPE_LABELS
from oracle.base import q
from functools import reduce

SUPERVISOR = 1000003


@query("citation_findings_by_severity", "doc_id:l total:l critical:l warning:l info:l", r"""
    SELECT doc_id, count(*) AS total, 0 AS critical, count(*) FILTER (sev = 'warning') AS warning, count(*) FILTER (sev = 'info') AS info FROM (
      SELECT doc_id, 'info' AS sev FROM zone WHERE NOT skip AND NOT is_empty AND regexp_matches(stripped, '\[\d+(?:\s*[,\-‒–—−]\s*\d+)*\]\s*\[\d+(?:\s*[,\-‒–—−]\s*\d+)*\]')
      UNION ALL SELECT doc_id, 'info' FROM zone WHERE NOT skip AND NOT is_empty AND regexp_matches(stripped, '\[\d+(\s*,\s*\d+)+\]')
      UNION ALL SELECT doc_id, 'warning' FROM (SELECT doc_id, unnest(regexp_extract_all(stripped, '\[\d+-\d+\]')) AS t FROM zone WHERE NOT skip)
        WHERE CAST(regexp_extract(t, '-(\d+)', 1) AS BIGINT) - CAST(regexp_extract(t, '(\d+)-', 1) AS BIGINT) > 20) GROUP BY doc_id""")
def _(f):
    found = [check(f.zoned) for check in (citations.citation_separators, citations.citation_combined, citations.citation_range_suspicious)]
    return db.finding_counts(reduce(lambda a, b: a.unionByName(b), found))


@query("D1_totals", "total_documents:l total_users:l total_students:l", f"""
    SELECT (SELECT count(*) FROM submissions WHERE user_id IN (SELECT user_id FROM people WHERE supervisor_id = {SUPERVISOR})) AS total_documents,
      (SELECT count(*) FROM people) AS total_users, (SELECT count(*) FROM people WHERE role = 'student' AND supervisor_id = {SUPERVISOR}) AS total_students""")
def _(f):
    return db.totals(f.submissions, f.users, SUPERVISOR)


_COUNTS = """SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'auto_fixed') AS fixed, count(*) FILTER (status = 'manual_required') AS manual,
    count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM found GROUP BY doc_id"""


@query("D2_report_averages", "avg_violations:d total_auto_fixed:l", f"""
    SELECT round(avg(total), 6) AS avg_violations, sum(fixed) AS total_auto_fixed FROM ({_COUNTS}) WHERE doc_id IN (SELECT doc_id FROM submissions)""")
def _(f):
    rows = db.report_averages(f.submissions, db.finding_counts(f.findings))
    return rows.withColumn("avg_violations", F.round("avg_violations", 6))


@query("D3_uploads_30d", "day:s uploads:l", """
    SELECT c.day, coalesce(n, 0) AS uploads FROM (SELECT CAST(unnest(generate_series(DATE '2001-07-03', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day) c
    LEFT JOIN (SELECT CAST(uploaded_at AS DATE) AS day, count(*) AS n FROM submissions GROUP BY 1) u ON c.day = u.day""")
def _(f):
    return db.uploads_by_day(f.submissions, F.expr("DATE '2001-08-01'"))


_CATEGORIES = ", ".join(f"('{k}', '{v}')" for k, v in TYPE_CATEGORIES.items())
_LABELS = ", ".join(f"('{k}', '{v}')" for k, v in TYPE_LABELS.items())


@query("D4_violations_by_category", "category:s count:l percent:l", f"""
    SELECT category, n AS count, round_even(n * 100.0 / sum(n) OVER (), 0) AS percent FROM (SELECT coalesce(c.category, 'Прочее') AS category, count(*) AS n
      FROM found f LEFT JOIN (VALUES {_CATEGORIES}) c(type, category) ON f.type = c.type GROUP BY 1)""")
def _(f):
    return db.violations_by_category(f.findings)


@query("D5_recent_uploads", "doc_id:l original_filename:s owner_full_name:s uploaded_at:t violations:l status:s", f"""
    SELECT s.doc_id, original_filename, p.full_name AS owner_full_name, uploaded_at, c.total AS violations, status
    FROM (SELECT * FROM submissions ORDER BY uploaded_at DESC, doc_id LIMIT 10) s JOIN people p ON s.user_id = p.user_id LEFT JOIN ({_COUNTS}) c ON s.doc_id = c.doc_id""")
def _(f):
    return db.recent_uploads(f.submissions, f.users, db.finding_counts(f.findings))


@query("D6_finding_counts", "doc_id:l total:l fixed:l manual:l critical:l warning:l info:l", _COUNTS)
def _(f):
    return db.finding_counts(f.findings)


@query("D7_student_card_counts", "doc_id:l critical_open:l warning_open:l auto_fixed:l", """
    SELECT doc_id, sum(CASE WHEN status = 'manual_required' AND severity = 'critical' THEN 1 ELSE 0 END) AS critical_open,
      sum(CASE WHEN status = 'manual_required' AND severity = 'warning' THEN 1 ELSE 0 END) AS warning_open, sum(CASE WHEN status = 'auto_fixed' THEN 1 ELSE 0 END) AS auto_fixed FROM found GROUP BY doc_id""")
def _(f):
    return db.student_card_counts(f.findings)


@query("D8_type_labels", "finding_id:s label:s", f"""
    SELECT finding_id, coalesce(l.label, 'Замечание оформления') AS label FROM found f LEFT JOIN (VALUES {_LABELS}) l(type, label) ON f.type = l.type""")
def _(f):
    return db.with_type_labels(f.findings)


@query("D9_finding_report_rows", "doc_id:l row_number:l label:s severity_label:s status_label:s original_text:s fixed_text:s", f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index NULLS LAST, finding_id) AS row_number, coalesce(l.label, 'Замечание оформления') AS label,
      CASE severity WHEN 'critical' THEN 'Критично' WHEN 'warning' THEN 'Предупреждение' ELSE 'Информация' END AS severity_label,
      CASE status WHEN 'auto_fixed' THEN 'Автоисправлено' WHEN 'manual_required' THEN 'Требует проверки' WHEN 'accepted' THEN 'Принято' ELSE 'Отклонено' END AS status_label,
      original_text, fixed_text FROM found f LEFT JOIN (VALUES {_LABELS}) l(type, label) ON f.type = l.type""")
def _(f):
    # Findings without a place come last.
    place = F.col("paragraph_index")
    rows = f.findings.withColumns({"placeless": place.isNull().cast("int"), "place": F.coalesce(place, F.lit(0))})
    return db.finding_report_rows(rows, ["placeless", "place", "finding_id"])


def _levels(f, column):
    return f.heading_eval.select("doc_id", "idx", F.col(column).alias("level"))


def _outcomes(f, mode="manual"):
    gold = _levels(f, "gold_level")
    predicted = _levels(f, "pred_level").where("level IS NOT NULL")
    if mode == "manual":
        return ql.heading_outcomes(gold.where("level IS NOT NULL"), predicted, mode, f.heading_eval)
    return ql.heading_outcomes(gold, predicted, mode, skip=f.heading_eval.where("idx < 5"))


_CONFUSION = """SELECT doc_id, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn,
    count(*) FILTER (gold_level = pred_level) AS level_correct, count(*) FILTER (gold_level <> pred_level) AS level_wrong
    FROM (SELECT *, gold_level IS NOT NULL AS g, pred_level IS NOT NULL AS p FROM heading_eval) GROUP BY doc_id"""
_CONFUSED = "doc_id:l tp:l fp:l fn:l tn:l level_correct:l level_wrong:l"


@query("Q1_heading_confusion_manual", _CONFUSED, _CONFUSION)
def _(f):
    return ql.heading_confusion(_outcomes(f), ["doc_id"])


@query("Q2_heading_confusion_word_style", _CONFUSED,
       _CONFUSION.replace("FROM heading_eval) GROUP BY", "FROM heading_eval WHERE idx >= 5 AND gold_level IS NOT NULL) GROUP BY"))
def _(f):
    return ql.heading_confusion(_outcomes(f, "word_style"), ["doc_id"])


@query("Q3_level_confusion", "confusion:s n:l", "SELECT concat(gold_level, '->', pred_level) AS confusion, count(*) AS n FROM heading_eval WHERE gold_level <> pred_level GROUP BY 1")
def _(f):
    return ql.level_confusion(_outcomes(f))


_PRF = f"""
    SELECT *, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1,
      round(coalesce(level_correct / nullif(level_correct + level_wrong, 0), 0), 4) AS level_accuracy FROM (
      SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM (
        SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, sum(level_correct) AS level_correct, sum(level_wrong) AS level_wrong FROM ({_CONFUSION})))"""


@query("Q4_prf", "tp:l fp:l fn:l tn:l precision:d recall:d f1:d level_accuracy:d", _PRF)
def _(f):
    return ql.prf(ql.heading_confusion(_outcomes(f), ["doc_id"]))


def _detected(f):
    return f._written("detected", lambda: f.findings.select("doc_id", "type", "paragraph_index", F.expr("CAST(conv(substr(finding_id, 1, 12), 16, 10) AS BIGINT)").alias("seq")))


def _expected(f):
    """Nine in ten findings, shifted by up to three paragraphs."""
    return _detected(f).where("seq % 10 <> 0").select("doc_id", "type", F.expr("paragraph_index + CAST(seq % 4 AS INT)").alias("paragraph_index"), "seq")


def _matches(f):
    return f._written("matches", lambda: ql.match_findings(_detected(f), _expected(f)))


def _judged(f):
    return f._written("outcomes", lambda: ql.match_outcomes(_detected(f), _expected(f), _matches(f)))


# One recursion step lets the next expected finding of every (document, type) take the first unused detected one that fits.
_MATCHED = f"""
    WITH RECURSIVE det AS (SELECT doc_id, type, paragraph_index AS spot, CAST(concat('0x', substr(finding_id, 1, 12)) AS BIGINT) AS seq FROM found),
    wanted AS (SELECT doc_id, type, spot + seq % 4 AS spot, seq, row_number() OVER (PARTITION BY doc_id, type ORDER BY seq) AS n FROM det WHERE seq % 10 <> 0),
    offers AS (SELECT doc_id, type, list({{'seq': seq, 'spot': spot}} ORDER BY seq) AS dets FROM det GROUP BY doc_id, type),
    taken AS (
      SELECT DISTINCT doc_id, type, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS exp_seq, CAST(NULL AS BIGINT) AS det_seq, CAST([] AS BIGINT[]) AS used FROM wanted
      UNION ALL
      SELECT doc_id, type, n, seq, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END FROM (
        SELECT t.doc_id, t.type, e.n, e.seq, t.used, list_min(list_transform(list_filter(o.dets, lambda d: NOT list_contains(t.used, d.seq) AND (
          t.type IN {q(ql.DOCUMENT_TYPES)} OR e.spot IS NULL OR d.spot IS NULL OR abs(d.spot - e.spot) <= {ql.TOLERANCE})), lambda d: d.seq)) AS pick
        FROM taken t JOIN wanted e ON e.doc_id = t.doc_id AND e.type = t.type AND e.n = t.n + 1 JOIN offers o ON o.doc_id = t.doc_id AND o.type = t.type))"""
_JUDGED = f"""{_MATCHED}
    SELECT e.doc_id, e.type, CASE WHEN t.det_seq IS NULL THEN 'fn' ELSE 'tp' END AS outcome, e.seq, e.spot AS paragraph_index
    FROM wanted e JOIN taken t ON t.doc_id = e.doc_id AND t.type = e.type AND t.exp_seq = e.seq
    UNION ALL SELECT d.doc_id, d.type, 'fp', d.seq, d.spot FROM det d
    WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.doc_id = d.doc_id AND t.type = d.type AND t.det_seq = d.seq)"""
_BY_TYPE = f"""SELECT type, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn
    FROM ({_JUDGED}) GROUP BY type"""
_RATIOS = f"SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM ({_BY_TYPE})"
_TYPES = f"SELECT type, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, type IN {q(ql.EXCLUDED_TYPES)} AS excluded FROM ({_RATIOS})"
_MICRO = f"""
    SELECT tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round(macro, 4) AS macro_f1 FROM (
      SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM (
        SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(f) AS macro FROM ({_RATIOS}) WHERE type NOT IN {q(ql.EXCLUDED_TYPES)}))"""


@query("Q5_match_findings", "doc_id:l type:s exp_seq:l det_seq:l", f"{_MATCHED} SELECT doc_id, type, exp_seq, det_seq FROM taken WHERE det_seq IS NOT NULL")
def _(f):
    return _matches(f)


@query("Q6_per_type_prf", "type:s tp:l fp:l fn:l precision:d recall:d f1:d excluded:b", _TYPES)
def _(f):
    return ql.per_type_prf(ql.per_type_counts(_judged(f)))


@query("Q6_summary_prf", "tp:l fp:l fn:l precision:d recall:d f1:d macro_f1:d", _MICRO)
def _(f):
    return ql.summary_prf(ql.per_type_counts(_judged(f)))


@query("Q6_type_report", "type:s tp:l fp:l fn:l precision:d recall:d f1:d excluded:b", _TYPES)
def _(f):
    return ql.per_type_prf(ql.per_type_counts(_judged(f)))


@query("Q6_micro_macro", "tp:l fp:l fn:l precision:d recall:d f1:d macro_f1:d", _MICRO)
def _(f):
    return ql.summary_prf(ql.per_type_counts(_judged(f)))


@query("Q7_error_examples", "doc_id:l outcome:s place_no:l example:s", f"""
    SELECT doc_id, outcome, rn AS place_no, concat(type, '@', coalesce(CAST(paragraph_index AS VARCHAR), 'None')) AS example FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, outcome ORDER BY seq) AS rn FROM ({_JUDGED}) WHERE outcome <> 'tp') WHERE rn <= 10""")
def _(f):
    return ql.error_examples(_judged(f))


_STATS = "count(*) AS runs, round(min({0}), 4) AS min, round(max({0}), 4) AS max, round(quantile_cont({0}, 0.5), 4) AS median, round(avg({0}), 4) AS mean, round(quantile_cont({0}, 0.95), 4) AS p95"
_STEPS = f"SELECT file_id, step, {_STATS.format('ms')} FROM (SELECT file_id, run_no, step, sum(duration_ms) AS ms FROM timing GROUP BY file_id, run_no, step) GROUP BY file_id, step"
_CORPUS = f"SELECT step, {_STATS.format('med')} FROM (SELECT step, median AS med FROM ({_STEPS})) GROUP BY step"
_NUM = "runs:l min:d max:d median:d mean:d p95:d"


def _steps(f):
    return ql.step_timings(f.timing)


@query("Q8_step_timings", "file_id:l step:s " + _NUM, _STEPS)
def _(f):
    return _steps(f)


@query("Q9_corpus_timings", "step:s " + _NUM, _CORPUS)
def _(f):
    return ql.corpus_timings(_steps(f))


@query("Q10_slowest_steps", "step:s median:d p95:d", f"SELECT step, median, p95 FROM ({_CORPUS}) ORDER BY median DESC, step LIMIT 5")
def _(f):
    return ql.slowest_steps(ql.corpus_timings(_steps(f)))


@query("Q10_weakest_types", "type:s f1:d tp:l fp:l fn:l", f"SELECT type, f1, tp, fp, fn FROM ({_TYPES}) ORDER BY f1, type LIMIT 5")
def _(f):
    return ql.weakest_types(ql.per_type_prf(ql.per_type_counts(_judged(f))))


@query("Q11_quality_summary", "headings_available:b findings_available:b timings_available:b steps:l heading_f1:d level_accuracy:d micro_f1:d macro_f1:d slowest_median:d", f"""
    SELECT true AS headings_available, true AS findings_available, true AS timings_available, (SELECT count(*) FROM ({_CORPUS})) AS steps, h.f1 AS heading_f1, h.level_accuracy,
      v.f1 AS micro_f1, v.macro_f1, (SELECT max(median) FROM ({_CORPUS})) AS slowest_median FROM ({_PRF}) h, ({_MICRO}) v""")
def _(f):
    heads = ql.prf(ql.heading_confusion(_outcomes(f), ["doc_id"]))
    return ql.quality_summary(heads, ql.summary_prf(ql.per_type_counts(_judged(f))), ql.corpus_timings(_steps(f)))
