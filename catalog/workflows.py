"""Review workflow."""

from pyspark.sql import functions as F

from catalog.core import RULES, query
from galley.operators import workflow as wf
from galley.sources import sinks
from galley.streaming import jobs

_DOC = "doc_id:l user_id:l uploaded_at:t status:s approval_status:s"
SUPERVISOR, STUDENT = 1000003, 17


@query("W1_documents_for_supervisor", _DOC, f"SELECT * FROM submissions WHERE user_id IN (SELECT user_id FROM people WHERE supervisor_id = {SUPERVISOR})")
def _(f):
    return wf.documents_for(f.submissions, f.users, "supervisor", SUPERVISOR)


@query("W1_documents_for_student", _DOC, f"SELECT * FROM submissions WHERE user_id = {STUDENT}")
def _(f):
    return wf.documents_for(f.submissions, f.users, "student", STUDENT)


@query("W2_access_check", "doc_id:l viewer_id:l allowed:b", """
    SELECT v.doc_id, v.viewer_id, coalesce(CASE w.role WHEN 'supervisor' THEN o.supervisor_id = v.viewer_id WHEN 'student' THEN s.user_id = v.viewer_id
      ELSE w.role IN ('dean', 'admin') END, false) AS allowed
    FROM (SELECT doc_id, unnest([user_id, 1000000 + doc_id % 12, 9]) AS viewer_id FROM submissions) v JOIN submissions s ON v.doc_id = s.doc_id
      LEFT JOIN people o ON s.user_id = o.user_id LEFT JOIN people w ON v.viewer_id = w.user_id""")
def _(f):
    docs = f.submissions
    asked = F.array("user_id", F.expr("CAST(1000000 + doc_id % 12 AS BIGINT)"), F.lit(9).cast("long"))
    return wf.access_check(docs, f.users, docs.select("doc_id", F.explode(asked).alias("viewer_id")))


_OPEN = "SELECT doc_id, count(*) AS n FROM found WHERE status = 'manual_required' GROUP BY doc_id"


@query("W3_unresolved_flag", "doc_id:l unresolved:l has_unresolved:b", f"""
    SELECT s.doc_id, coalesce(n, 0) AS unresolved, coalesce(n, 0) > 0 AS has_unresolved FROM submissions s LEFT JOIN ({_OPEN}) o ON s.doc_id = o.doc_id""")
def _(f):
    return wf.unresolved_flag(f.submissions, f.findings)


@query("W4_last_comment_at", "doc_id:l last_comment_at:t", "SELECT doc_id, max(created_at) AS last_comment_at FROM notes GROUP BY doc_id")
def _(f):
    return wf.last_comment_at(f.comments)


_LISTING = f"""
    SELECT s.*, p.full_name AS owner_full_name, coalesce(o.n, 0) > 0 AS has_unresolved, c.at_time AS last_comment_at, v.n_name AS version_name FROM submissions s
    LEFT JOIN people p ON s.user_id = p.user_id LEFT JOIN ({_OPEN}) o ON s.doc_id = o.doc_id
    LEFT JOIN (SELECT doc_id, max(created_at) AS at_time FROM notes GROUP BY doc_id) c ON s.doc_id = c.doc_id LEFT JOIN nation v ON s.version_id = v.n_nationkey"""


def _listing(f):
    return wf.document_listing(f.submissions, f.users, f.findings, f.comments, f.versions)


@query("W5_document_listing", _DOC + " owner_full_name:s has_unresolved:b last_comment_at:t version_name:s", _LISTING)
def _(f):
    return _listing(f)


@query("W6_unread_comments", "doc_id:l last_comment_at:t seen_at:t", """
    SELECT c.doc_id, c.at_time AS last_comment_at, v.seen_at FROM (SELECT doc_id, max(created_at) AS at_time FROM notes GROUP BY doc_id) c
    LEFT JOIN (SELECT doc_id, min(created_at) + doc_id % 4 * INTERVAL '1' HOUR AS seen_at FROM notes WHERE doc_id % 3 <> 0 GROUP BY doc_id) v ON c.doc_id = v.doc_id
    WHERE v.seen_at IS NULL OR c.at_time > v.seen_at""")
def _(f):
    seen = f.comments.where("doc_id % 3 <> 0").groupBy("doc_id").agg(F.min("created_at").alias("first"))
    seen = seen.select("doc_id", F.expr("first + make_interval(0, 0, 0, 0, CAST(doc_id % 4 AS INT), 0, 0)").alias("seen_at"))
    return wf.unread_comments(wf.last_comment_at(f.comments), seen)


@query("W7_comment_thread", "doc_id:l created_at:t author_role:s body:s", "SELECT doc_id, created_at, author_role, body FROM notes")
def _(f):
    return wf.comment_thread(f.comments)


# Who acts on a document of user u, and the states of users from a time on.
_ACTOR = """CASE WHEN action = 'submit' THEN CASE event_id % 6 WHEN 5 THEN 1000000 + u % 10 WHEN 4 THEN u + 1 ELSE u END
    ELSE CASE event_id % 6 WHEN 0 THEN u WHEN 1 THEN 1000009 WHEN 2 THEN 1000000 + (u + 1) % 10 ELSE 1000000 + u % 10 END END"""
_CHANGED = {
    "user_id": "CASE WHEN event_type = 'view' THEN o_custkey ELSE 1000000 + event_id % 10 END",
    "at": "CAST(ts AS TIMESTAMP)",
    "seq": "event_id",
    "role": "CASE WHEN event_type = 'view' THEN 'student' WHEN event_id % 3 = 0 THEN 'student' WHEN event_id % 3 = 1 THEN 'supervisor' ELSE 'dean' END",
    "supervisor_id": "CASE WHEN event_type <> 'view' OR event_id % 3 = 0 THEN NULL ELSE 1000000 + (o_custkey + event_id % 3 - 1) % 10 END",
}
_CHANGES = "event_type = 'view' AND event_id % 5 = 0 OR event_type = 'click' AND event_id % 40 < 10"


_JUDGED = f"""
    SELECT *, CASE WHEN form IS NOT NULL THEN form WHEN action <> 'submit' AND NOT coalesce(before = 'submit', approval_status = 'pending_review', false) THEN 'not_pending' ELSE 'done' END AS outcome
    FROM (SELECT *, last_value(CASE WHEN form IS NULL THEN action END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
      SELECT event_id, doc_id, action, decided_at, nullif(comment, '') AS comment, approval_status,
        CASE WHEN action <> 'submit' AND coalesce(role, 'none') NOT IN ('supervisor', 'dean', 'admin') THEN 'not_staff'
          WHEN action = 'reject' AND comment = '' THEN 'comment_required'
          WHEN NOT coalesce(CASE role WHEN 'supervisor' THEN supervisor = actor_id WHEN 'student' THEN u = actor_id ELSE role IN ('dean', 'admin') END, false) THEN 'no_access'
          WHEN action = 'submit' AND u <> actor_id THEN 'not_owner' WHEN action = 'submit' AND status <> 'done' THEN 'not_processed'
          WHEN action = 'submit' AND supervisor IS NULL THEN 'no_supervisor' END AS form
      FROM (SELECT a.*, CASE WHEN ca.user_id IS NOT NULL THEN ca.role ELSE pa.role END AS role,
          CASE WHEN co.user_id IS NOT NULL THEN co.supervisor_id ELSE po.supervisor_id END AS supervisor
        FROM (SELECT *, {_ACTOR} AS actor_id FROM (
          SELECT e.*, s.user_id AS u, s.status, s.approval_status FROM verdicts e JOIN submissions s ON e.doc_id = s.doc_id WHERE action <> 'comment')) a
        LEFT JOIN people pa ON pa.user_id = a.actor_id LEFT JOIN people po ON po.user_id = a.u
        ASOF LEFT JOIN (SELECT {", ".join(f"{v} AS {k}" for k, v in _CHANGED.items())} FROM events e JOIN orders o ON e.user_id = o.o_orderkey WHERE {_CHANGES}) ca
          ON ca.user_id = a.actor_id AND a.decided_at >= ca.at
        ASOF LEFT JOIN (SELECT {", ".join(f"{v} AS {k}" for k, v in _CHANGED.items())} FROM events e JOIN orders o ON e.user_id = o.o_orderkey WHERE {_CHANGES}) co
          ON co.user_id = a.u AND a.decided_at >= co.at)))"""


def _judge(f):
    from galley.fixtures import table
    owners = f.submissions.select("doc_id", F.col("user_id").alias("u"))
    events = f.decisions.join(owners, "doc_id").withColumn("actor_id", F.expr(_ACTOR)).drop("u")
    orders = table(f.spark, f.dir, "orders").select(F.col("o_orderkey").alias("user_id"), "o_custkey")
    logged = table(f.spark, f.dir, "events").where(_CHANGES).join(orders, "user_id")
    changes = logged.selectExpr(*[f"{v} AS {k}" for k, v in _CHANGED.items()])
    return wf.judge_decisions(events, f.submissions, f.users, changes)


def _judged(f):
    return f._written("judged", lambda: _judge(f))


@query("W8_apply_decisions", "event_id:l doc_id:l action:s outcome:s", _JUDGED)
def _(f):
    return _judge(f)


@query("W8_approval_state", "doc_id:l approval_status:s approval_comment:s approval_decided_at:t", f"""
    SELECT s.doc_id, CASE j.action WHEN 'submit' THEN 'pending_review' WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE s.approval_status END AS approval_status,
      CASE WHEN j.action <> 'submit' THEN j.comment END AS approval_comment, CASE WHEN j.action <> 'submit' THEN j.decided_at END AS approval_decided_at
    FROM submissions s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY event_id DESC) AS rn FROM ({_JUDGED}) WHERE outcome = 'done') WHERE rn = 1) j ON s.doc_id = j.doc_id""")
def _(f):
    return wf.approval_state(_judged(f), f.submissions)


@query("W7_review_history", "doc_id:l event_id:l decision:s comment:s decided_at:t", f"""
    SELECT doc_id, event_id, CASE action WHEN 'approve' THEN 'approved' ELSE 'rejected' END AS decision, comment, decided_at FROM ({_JUDGED}) WHERE outcome = 'done' AND action <> 'submit'""")
def _(f):
    return wf.review_rounds(_judged(f)).orderBy("doc_id", "decided_at")


_ACTION = """CASE WHEN coalesce(paragraph_index, 0) % 3 = 0 THEN 'accept' WHEN coalesce(paragraph_index, 0) % 3 = 1 THEN 'reject' ELSE 'view' END"""


@query("W9_finding_actions", "finding_id:s status:s", f"""
    SELECT finding_id, CASE {_ACTION} WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' ELSE CASE WHEN doc_id % 2 = 0 THEN 'rejected' ELSE status END END AS status FROM found""")
def _(f):
    first = f.findings.where("doc_id % 2 = 0").select("finding_id", F.lit("reject").alias("action"), F.lit(1).alias("seq"))
    second = f.findings.select("finding_id", F.expr(_ACTION).alias("action"), F.lit(2).alias("seq"))
    return wf.finding_actions(f.findings, first.unionByName(second))


@query("W10_supervisor_comment", "finding_id:s supervisor_comment:s", """
    SELECT finding_id, CASE WHEN doc_id % 3 = 0 AND paragraph_index % 2 = 0 THEN concat('see ', section_title) END AS supervisor_comment FROM found""")
def _(f):
    rows = f.findings.where("doc_id % 3 = 0")
    set_ = rows.select("finding_id", F.expr("concat(' see ', section_title)").alias("comment"), F.lit(1).alias("seq"))
    cleared = rows.where("paragraph_index % 2 = 1 OR paragraph_index IS NULL").select("finding_id", F.lit("  ").alias("comment"), F.lit(2).alias("seq"))
    return wf.supervisor_comment(f.findings, set_.unionByName(cleared))


@query("W11_dismiss_heading_confirms", "finding_id:s status:s", """
    SELECT f.finding_id, CASE WHEN h.doc_id IS NOT NULL AND f.type = 'heading_confirm' AND f.status = 'manual_required' THEN 'accepted' ELSE f.status END AS status
    FROM found f LEFT JOIN (SELECT DISTINCT doc_id, paragraph_index FROM found WHERE type = 'heading_confirm' AND paragraph_index IS NOT NULL AND doc_id % 2 = 0) h
      ON f.doc_id = h.doc_id AND f.paragraph_index = h.paragraph_index""")
def _(f):
    return wf.dismiss_confirms(f.findings, f.findings.where("doc_id % 2 = 0").select("finding_id"))


@query("W12_cascade_renumber", "doc_id:l paragraph_index:l new_number:s", """
    SELECT c.doc_id, c.paragraph_index, regexp_replace(array_to_string(list_concat(['9', '9'], string_split(c.original_text, '.')[len(string_split(r.original_text, '.')) + 1:]), '.'), '\\.+$', '') AS new_number
    FROM found c JOIN (SELECT DISTINCT doc_id, paragraph_index, original_text FROM found WHERE type = 'heading_number_conflict' AND caused_by_index IS NULL AND paragraph_index IS NOT NULL) r
      ON c.doc_id = r.doc_id AND c.caused_by_index = r.paragraph_index""")
def _(f):
    rows = f.findings
    roots = rows.where("type = 'heading_number_conflict' AND caused_by_index IS NULL AND paragraph_index IS NOT NULL")
    fixes = roots.select("doc_id", "paragraph_index", F.col("original_text").alias("number"), F.lit("9.9").alias("chosen")).distinct()
    conflicts = rows.withColumn("number", F.col("original_text"))
    return wf.cascade_renumber(conflicts, fixes)


@query("W13_merge_recheck", "doc_id:l type:s paragraph_index:l section_title:s status:s", """
    SELECT doc_id, type, paragraph_index, section_title, status FROM found WHERE type <> 'heading_number_conflict' OR doc_id % 2 = 1
    UNION ALL SELECT n.doc_id, n.type, n.paragraph_index, n.section_title, CASE WHEN r.title IS NOT NULL THEN 'rejected' ELSE 'manual_required' END
    FROM (SELECT doc_id, 'heading_number_conflict' AS type, paragraph_index, concat('SECTION ', paragraph_index % 50) AS section_title FROM found WHERE doc_id % 2 = 0 AND type = 'heading_confirm') n
    LEFT JOIN (SELECT DISTINCT doc_id, lower(section_title) AS title FROM found WHERE type = 'heading_number_conflict' AND status = 'rejected') r ON n.doc_id = r.doc_id AND lower(n.section_title) = r.title""")
def _(f):
    rows = f.findings
    fresh = rows.where("doc_id % 2 = 0 AND type = 'heading_confirm'").select(
        "doc_id", F.lit("heading_number_conflict").alias("type"), "paragraph_index",
        F.expr("concat('SECTION ', coalesce(CAST(paragraph_index % 50 AS STRING), ''))").alias("section_title"), F.lit("manual_required").alias("status"),
    )
    return wf.merge_recheck(rows, fresh, rows.where("doc_id % 2 = 0").select("doc_id").distinct())


@query("W14_replace_caption_findings", "doc_id:l type:s status:s paragraph_index:l original_text:s fixed_text:s", """
    SELECT doc_id, type, status, paragraph_index, original_text, fixed_text FROM found WHERE type <> 'caption_renumbered' OR doc_id % 2 = 1
    UNION ALL SELECT doc_id, 'caption_renumbered', 'manual_required', paragraph_index, original_text, '1' FROM found WHERE doc_id % 2 = 0 AND type = 'heading_confirm' AND original_text <> '1'""")
def _(f):
    rows = f.findings
    changes = rows.where("doc_id % 2 = 0 AND type = 'heading_confirm'").select(
        "doc_id", "paragraph_index", F.col("original_text").alias("source_text"), F.lit("1").alias("new_text"))
    return wf.replace_caption_findings(rows, changes, rows.where("doc_id % 2 = 0").select("doc_id").distinct())


@query("W15_relocate_anchor", "finding_id:s target:l", """
    WITH q AS (SELECT concat(doc_id, '-', idx) AS finding_id, doc_id, idx + CASE doc_id % 4 WHEN 1 THEN 5 WHEN 2 THEN 60 WHEN 3 THEN -4 ELSE 0 END AS at_idx,
        CASE WHEN doc_id % 6 = 5 THEN 'нет такого заголовка вовсе' WHEN norm <> '' THEN norm END AS title FROM heads),
    p AS (SELECT doc_id, idx, norm, outline_level IS NOT NULL AS o FROM zone WHERE NOT in_toc),
    m AS (SELECT finding_id, p.idx, CASE WHEN p.idx = at_idx AND (title IS NULL OR norm = title OR (length(title) > 10 AND contains(norm, title))) THEN 0
        WHEN title IS NOT NULL AND abs(p.idx - at_idx) <= 20 AND (norm = title OR (length(title) > 10 AND contains(norm, title))) THEN CASE WHEN o THEN 1 ELSE 2 END
        WHEN title IS NOT NULL AND o AND (norm = title OR (length(title) > 10 AND contains(norm, title))) THEN 3 WHEN p.idx = at_idx THEN 4 END AS rk
      FROM q JOIN p ON q.doc_id = p.doc_id)
    SELECT q.finding_id, b.idx AS target FROM q LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY rk, idx) AS rn FROM m WHERE rk IS NOT NULL) WHERE rn = 1) b
      ON q.finding_id = b.finding_id""")
def _(f):
    lines = f.zoned.select("doc_id", "idx", "norm", F.col("outline_level").isNotNull().alias("has_outline"), F.col("in_contents").alias("is_contents"))
    asked = f.headings.select(
        F.expr("concat(doc_id, '-', idx)").alias("finding_id"), "doc_id",
        F.expr("CAST(idx + CASE doc_id % 4 WHEN 1 THEN 5 WHEN 2 THEN 60 WHEN 3 THEN -4 ELSE 0 END AS INT)").alias("paragraph_index"),
        F.expr("CASE WHEN doc_id % 6 = 5 THEN 'нет такого заголовка вовсе' WHEN norm <> '' THEN norm END").alias("section_title"),
    )
    return wf.relocate_anchors(lines, asked)


@query("W16_revertable_findings", "finding_id:s needs_original:b", """
    SELECT finding_id, type IN ('citation_separator_missing', 'paragraph_spacing', 'font_size_inconsistency') AS needs_original FROM found
    WHERE status = 'auto_fixed' AND type IN ('heading_recovered', 'forbidden_heading', 'long_table_split_warning', 'table_mass_bold_removed', 'citation_separator_missing', 'paragraph_spacing', 'font_size_inconsistency')""")
def _(f):
    return wf.revertable_findings(f.findings)


def _snapshots(f):
    return f.decisions.select("doc_id", F.col("event_id").alias("snapshot_index"), F.col("action").alias("action_type"), F.col("decided_at").alias("created_at"))


def _requests(f):
    return f.submissions.where("doc_id % 2 = 0").select("doc_id", F.lit("edit").alias("action_type"), F.col("uploaded_at").alias("created_at"))


_SNAPS = "SELECT doc_id, event_id AS snapshot_index, action AS action_type FROM verdicts"


@query("W17_snapshot_append", "doc_id:l snapshot_index:l action_type:s", f"""
    SELECT doc_id, snapshot_index, action_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY snapshot_index DESC) AS rn FROM ({_SNAPS})) WHERE rn <= 29
      OR doc_id % 2 = 1 OR doc_id NOT IN (SELECT doc_id FROM submissions)
    UNION ALL SELECT s.doc_id, coalesce((SELECT max(snapshot_index) FROM ({_SNAPS}) x WHERE x.doc_id = s.doc_id), 0) + 1, 'edit' FROM submissions s WHERE s.doc_id % 2 = 0""")
def _(f):
    kept, new = wf.snapshot_append(_snapshots(f), _requests(f))
    return kept.unionByName(new)


@query("W17_snapshot_findings", "doc_id:l snapshot_index:l finding_id:s status:s", f"""
    SELECT f.doc_id, coalesce(x.m, 0) + 1 AS snapshot_index, f.finding_id, f.status FROM found f JOIN submissions s ON f.doc_id = s.doc_id
    LEFT JOIN (SELECT doc_id, max(snapshot_index) AS m FROM ({_SNAPS}) GROUP BY doc_id) x ON f.doc_id = x.doc_id WHERE f.doc_id % 2 = 0""")
def _(f):
    return wf.snapshot_findings(wf.snapshot_append(_snapshots(f), _requests(f))[1], f.findings)


@query("W18_snapshot_list", "doc_id:l snapshot_index:l action_type:s", _SNAPS)
def _(f):
    return wf.snapshot_list(_snapshots(f))


def _rollback(f):
    snaps = f.decisions.where("doc_id % 2 = 0").select("doc_id", F.col("event_id").alias("snapshot_index"), F.lit("edit").alias("action_type"))
    targets = snaps.groupBy("doc_id").agg(F.min("snapshot_index").alias("snapshot_index"))
    old = f.findings.where("paragraph_index % 2 = 0").withColumn("status", F.lit("auto_fixed"))
    dump = old.join(targets, "doc_id")
    return wf.snapshot_rollback(f.findings, snaps, dump, targets)


_TARGETS = "SELECT doc_id, min(event_id) AS k FROM verdicts WHERE doc_id % 2 = 0 GROUP BY doc_id"


@query("W19_snapshot_rollback", "doc_id:l finding_id:s status:s", f"""
    SELECT doc_id, finding_id, CASE WHEN doc_id IN (SELECT doc_id FROM ({_TARGETS})) THEN 'auto_fixed' ELSE status END AS status FROM found
    WHERE doc_id NOT IN (SELECT doc_id FROM ({_TARGETS})) OR paragraph_index % 2 = 0""")
def _(f):
    return _rollback(f)[0]


@query("W19_rollback_counters", "doc_id:l total:l fixed:l manual:l", f"""
    SELECT t.doc_id, count(f.doc_id) AS total, count(f.doc_id) AS fixed, 0 AS manual FROM ({_TARGETS}) t
    LEFT JOIN (SELECT * FROM found WHERE paragraph_index % 2 = 0) f ON t.doc_id = f.doc_id GROUP BY t.doc_id""")
def _(f):
    return _rollback(f)[1]


@query("W19_snapshots_left", "doc_id:l snapshot_index:l", f"SELECT doc_id, k AS snapshot_index FROM ({_TARGETS})")
def _(f):
    return _rollback(f)[2]


_NOW = "TIMESTAMP '1998-06-01 00:00:00'"


@query("W20_expired_documents", "doc_id:l path:s", f"""
    SELECT doc_id, unnest(list_filter([original_filename, CASE WHEN n > 4 THEN concat('report_', doc_id) END], lambda p: p IS NOT NULL)) AS path FROM (
      SELECT s.doc_id, s.original_filename, (SELECT count(*) FROM found f WHERE f.doc_id = s.doc_id) AS n FROM submissions s WHERE expires_at < {_NOW})""")
def _(f):
    reports = f.findings.groupBy("doc_id").agg(F.count("*").alias("n")).select(
        "doc_id", F.expr("CASE WHEN n > 4 THEN concat('report_', doc_id) END").alias("report_path"))
    expired = wf.expired_documents(f.submissions, F.expr(_NOW))
    return wf.purge_paths(expired, reports, ["original_filename", "report_path"])


@query("W21_latest_per_student", "doc_id:l purged:b", """
    SELECT doc_id, rn > 1 AS purged FROM (SELECT doc_id, row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at DESC, doc_id DESC) AS rn FROM submissions)""")
def _(f):
    return wf.latest_per_student(f.submissions, f.users)


@query("W22_expires_at", "doc_id:l expires_at:t", "SELECT doc_id, uploaded_at + INTERVAL '90' DAY AS expires_at FROM submissions")
def _(f):
    return wf.expires_at(f.submissions, RULES)


@query("W23_active_rules", "version_id:l name:s documents:l", """
    SELECT n_nationkey AS version_id, n_name AS name, (SELECT count(*) FROM submissions s WHERE s.version_id = n_nationkey) AS documents FROM nation WHERE n_nationkey = 1""")
def _(f):
    used = f.submissions.groupBy("version_id").agg(F.count("*").alias("n"))
    return wf.active_rules(f.versions).join(used, "version_id", "left").withColumn("documents", F.coalesce("n", F.lit(0)))


@query("W24_user_lists", "user_id:l full_name:s role:s", "SELECT user_id, full_name, role FROM people WHERE role = 'supervisor'")
def _(f):
    return wf.user_list(f.users, role="supervisor").orderBy("full_name")


@query("W24_my_students", "user_id:l full_name:s", f"SELECT user_id, full_name FROM people WHERE supervisor_id = {SUPERVISOR} AND (contains(lower(full_name), '1') OR contains(email, '1'))")
def _(f):
    return wf.user_list(f.users, supervisor_id=SUPERVISOR, search=" 1 ")


@query("W25_search_documents", _DOC + " owner_full_name:s", f"""
    SELECT * FROM ({_LISTING}) WHERE approval_status = 'pending_review' AND (contains(lower(original_filename), '77') OR contains(lower(owner_full_name), '77'))""")
def _(f):
    return wf.search_documents(_listing(f), "77", "pending_review", "name")


@query("W26_order_findings", "finding_id:s order_group:l order_severity:l", """
    SELECT finding_id, CASE WHEN status = 'manual_required' THEN CASE WHEN type IN ('heading_confirm', 'heading_number_conflict', 'possible_missed_heading', 'caption_renumbered',
        'figures_renumbered', 'tables_renumbered') THEN 0 ELSE 1 END WHEN status = 'auto_fixed' THEN 2 ELSE 3 END AS order_group,
      CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END AS order_severity FROM found""")
def _(f):
    return wf.order_findings(f.findings)


@query("W27_group_cascades", "finding_id:s part:s group_index:l", """
    WITH c AS (SELECT * FROM found WHERE type = 'heading_number_conflict')
    SELECT finding_id, CASE WHEN c.caused_by_index IS NULL THEN 'root' WHEN r.doc_id IS NOT NULL THEN 'child' ELSE 'orphan' END AS part,
      CASE WHEN r.doc_id IS NOT NULL THEN c.caused_by_index ELSE c.paragraph_index END AS group_index
    FROM c LEFT JOIN (SELECT DISTINCT doc_id, paragraph_index FROM c WHERE caused_by_index IS NULL) r ON c.doc_id = r.doc_id AND c.caused_by_index = r.paragraph_index""")
def _(f):
    return wf.group_cascades(f.findings.where("type = 'heading_number_conflict'"))


@query("W28_finding_anchor", "finding_id:s anchor:s", """
    SELECT finding_id, CASE WHEN (type IN ('caption_renumbered', 'forbidden_heading', 'heading_rename') OR status = 'auto_fixed') AND fixed_text IS NOT NULL THEN fixed_text
      WHEN length(original_text) > length(section_title) THEN original_text ELSE section_title END AS anchor FROM found""")
def _(f):
    return wf.finding_anchor(f.findings)


@query("W29_document_timeline", "doc_id:l step:l label:s happened_at:t", """
    SELECT doc_id, 1 AS step, 'Загружен' AS label, uploaded_at AS happened_at FROM submissions
    UNION ALL SELECT doc_id, 2, CASE status WHEN 'done' THEN 'Обработан' ELSE 'Ошибка обработки' END, uploaded_at FROM submissions WHERE status IN ('done', 'error')
    UNION ALL SELECT doc_id, 3, CASE approval_status WHEN 'pending_review' THEN 'Отправлен руководителю' WHEN 'approved' THEN 'Принят руководителем' ELSE 'Отклонён руководителем' END, NULL
      FROM submissions WHERE approval_status IS NOT NULL""")
def _(f):
    return wf.document_timeline(f.submissions)


# Every fifth role event concerns one of the actors, so that they stop and start being staff.
_MOVE_COLUMNS = {
    "seq": "event_id",
    "user_id": "CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 1000000 + event_id % 3 ELSE user_id END",
    "kind": "CASE event_type WHEN 'signup' THEN 'assign' WHEN 'error' THEN 'unassign' WHEN 'purchase' THEN 'role' END",
    "value": "CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'supervisor' ELSE 'student' END WHEN event_id % 8 = 0 THEN 'dean' ELSE 'student' END",
    "actor_id": "1000000 + event_id % 3",
}
_MOVES = f"""SELECT {', '.join(f'{v} AS {k}' for k, v in _MOVE_COLUMNS.items())} FROM events WHERE event_type IN ('signup', 'error', 'purchase')"""


@query("W30_assignment_updates", "user_id:l role:s supervisor_id:l", f"""
    WITH m AS ({_MOVES}), r AS (SELECT user_id, seq, value FROM m WHERE kind = 'role'),
    j AS (SELECT m.user_id, m.seq, m.kind, m.actor_id, coalesce(t.value, p.role) AS user_role, coalesce(a.value, q.role) AS actor_role, p.supervisor_id AS stored
      FROM (SELECT * FROM m WHERE kind <> 'role') m JOIN people p ON p.user_id = m.user_id LEFT JOIN people q ON q.user_id = m.actor_id
      ASOF LEFT JOIN r t ON m.user_id = t.user_id AND m.seq > t.seq ASOF LEFT JOIN r a ON m.actor_id = a.user_id AND m.seq > a.seq),
    h AS (SELECT *, last_value(CASE WHEN kind = 'assign' THEN actor_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder
      FROM j WHERE actor_role IN ('supervisor', 'dean', 'admin') AND (kind = 'unassign' OR user_role = 'student')),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM h WHERE kind = 'assign' OR coalesce(holder, stored) = actor_id) WHERE rn = 1),
    n AS (SELECT user_id, arg_max(value, seq) AS value FROM r GROUP BY user_id)
    SELECT p.user_id, coalesce(n.value, p.role) AS role, CASE WHEN l.user_id IS NULL THEN p.supervisor_id WHEN l.kind = 'assign' THEN l.actor_id END AS supervisor_id
    FROM people p LEFT JOIN n ON p.user_id = n.user_id LEFT JOIN l ON p.user_id = l.user_id""")
def _(f):
    from galley.fixtures import table
    rows = table(f.spark, f.dir, "events").selectExpr(*[f"{v} AS {k}" for k, v in _MOVE_COLUMNS.items()])
    return wf.assignment_updates(f.users, rows.where("kind IS NOT NULL"))


@query("W32_filter_findings", "finding_id:s", "SELECT finding_id FROM found WHERE severity = 'critical' AND status = 'manual_required'")
def _(f):
    return wf.filter_findings(f.findings, "critical", "manual_required")


@query("S5_replace_findings", "doc_id:l type:s status:s", """
    SELECT doc_id, type, status FROM found WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, type, 'accepted' FROM found WHERE doc_id % 2 = 0 AND severity = 'critical'""")
def _(f):
    rows = f.findings
    fresh = rows.where("doc_id % 2 = 0 AND severity = 'critical'").withColumn("status", F.lit("accepted"))
    return sinks.replace_findings(rows, fresh, rows.where("doc_id % 2 = 0").select("doc_id").distinct())


@query("R2_job_status", "doc_id:l status:s progress:l error:s", """
    SELECT doc_id, CASE step WHEN 'done' THEN 'done' WHEN 'error' THEN 'error' ELSE 'processing' END AS status,
      CASE step WHEN 'started' THEN 10 WHEN 'checked' THEN 75 WHEN 'reported' THEN 85 ELSE 100 END AS progress, CASE WHEN step = 'error' THEN concat('e', seq) END AS error
    FROM (SELECT user_id AS doc_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'started' WHEN 'click' THEN 'checked' WHEN 'view' THEN 'reported' WHEN 'purchase' THEN 'done' ELSE 'error' END AS step,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE event_type WHEN 'signup' THEN 10 WHEN 'click' THEN 75 WHEN 'view' THEN 85 ELSE 100 END DESC) AS rn FROM events) WHERE rn = 1""")
def _(f):
    from galley.fixtures import table
    events = table(f.spark, f.dir, "events").selectExpr("user_id AS doc_id", """CASE event_type WHEN 'signup' THEN 'started' WHEN 'click' THEN 'checked'
        WHEN 'view' THEN 'reported' WHEN 'purchase' THEN 'done' ELSE 'error' END AS step""", "concat('e', event_id) AS message", "ts")
    return jobs.latest_status(events)


@query("R3_uploads_per_day", "day:s uploads:l", "SELECT CAST(uploaded_at AS DATE) AS day, count(*) AS uploads FROM submissions GROUP BY CAST(uploaded_at AS DATE)")
def _(f):
    return jobs.uploads_per_day(f.submissions)


@query("R4_retention_sweep", "doc_id:l", f"SELECT doc_id FROM submissions WHERE NOT expires_at < {_NOW}")
def _(f):
    return jobs.retention_sweep(f.submissions, F.expr(_NOW))[0]
