"""Who may submit and decide, by the roles and supervisors at the time of the event."""

from galley.operators import workflow as wf

USERS = [(1, "student", 10), (2, "student", None), (3, "student", 10), (10, "supervisor", None), (11, "supervisor", None), (20, "dean", None)]
DOCS = [(100, 1, "done", None), (200, 2, "done", "pending_review"), (300, 3, "processing", None)]
# (event_id, doc_id, action, actor_id, comment) in the order of time; the time is the event's number.
EVENTS = [
    (1, 100, "submit", 3, None), (2, 100, "submit", 10, None), (3, 100, "submit", 20, None), (4, 100, "approve", 10, None),
    (5, 100, "submit", 1, None), (6, 100, "approve", 1, None), (7, 100, "approve", 11, None), (8, 100, "approve", None, None),
    (9, 100, "reject", 10, "  "), (10, 100, "approve", 99, "x"), (11, 100, "approve", 10, " ok "), (12, 100, "reject", 10, "late"),
    (21, 100, "submit", 1, None), (22, 100, "approve", 10, None), (23, 100, "reject", 11, "no"),
    (24, 200, "submit", 2, None), (25, 200, "approve", 20, None), (26, 300, "submit", 3, None), (27, 300, "comment", 3, "x"),
    (31, 100, "submit", 1, None), (32, 100, "approve", 11, None),
]
CHANGES = [(1, 20, 1, "student", 10), (1, 20, 2, "student", 11), (11, 30, 3, "student", None)]
EXPECTED = {
    1: "no_access", 2: "not_owner", 3: "not_owner", 4: "not_pending", 5: "done", 6: "not_staff", 7: "no_access", 8: "not_staff",
    9: "comment_required", 10: "not_staff", 11: "done", 12: "not_pending", 21: "done", 22: "no_access", 23: "done",
    24: "no_supervisor", 25: "done", 26: "not_processed", 31: "done", 32: "not_staff",
}


def tables(spark, changes=True):
    events = spark.createDataFrame(
        [(e, d, a, who, c, e) for e, d, a, who, c in EVENTS], "event_id long, doc_id long, action string, actor_id long, comment string, decided_at long"
    )
    docs = spark.createDataFrame(DOCS, "doc_id long, user_id long, status string, approval_status string")
    users = spark.createDataFrame(USERS, "user_id long, role string, supervisor_id long")
    moved = spark.createDataFrame(CHANGES, "user_id long, at long, seq long, role string, supervisor_id long")
    return events, docs, users, moved if changes else None


def test_guards_as_of_the_event(spark):
    judged = wf.judge_decisions(*tables(spark))
    assert {r.event_id: r.outcome for r in judged.collect()} == EXPECTED
    assert {(r.doc_id, r.event_id, r.decision, r.comment) for r in wf.review_rounds(judged).collect()} == {
        (100, 11, "approved", "ok"), (100, 23, "rejected", "no"), (200, 25, "approved", None)
    }
    state = {r.doc_id: r.approval_status for r in wf.approval_state(judged, tables(spark)[1]).collect()}
    assert state == {100: "pending_review", 200: "approved", 300: None}


def test_guards_without_changes(spark):
    got = {r.event_id: r.outcome for r in wf.judge_decisions(*tables(spark, changes=False)).collect()}
    assert got == EXPECTED | {22: "done", 23: "no_access", 32: "no_access"}


def test_no_events(spark):
    events, docs, users, changes = tables(spark)
    assert wf.judge_decisions(events.limit(0), docs, users, changes).isEmpty()


def test_anchors_by_place_window_and_title(spark):
    lines = [(1, i, f"раздел номер {i} о методах", True, False) for i in range(100)] + [(1, 100, "введение", True, False), (1, 101, "оглавление работы", True, True)]
    asked = [
        ("same", 1, 5, "раздел номер 5 о методах"), ("near", 1, 30, "раздел номер 12 о методах"), ("edge", 1, 32, "номер 12 о методах"),
        ("far", 1, 3, "номер 77 о методах"), ("first", 1, 60, "раздел номер 1"), ("short", 1, 7, "введение"), ("none", 1, 9, "нет такого заголовка"),
        ("blank", 1, None, "введение"), ("untitled", 1, 4, None), ("gone", 2, 4, "введение"), ("contents", 1, 101, "оглавление работы"),
    ]
    frames = (
        spark.createDataFrame(lines, "doc_id long, idx int, norm string, has_outline boolean, is_contents boolean"),
        spark.createDataFrame(asked, "finding_id string, doc_id long, paragraph_index int, section_title string"),
    )
    found = wf.relocate_anchors(*frames)
    assert {r.finding_id: r.target for r in found.collect()} == {
        "same": 5, "near": 12, "edge": 12, "far": 77, "first": 1, "short": 100, "none": 9, "blank": None, "untitled": 4, "gone": None, "contents": None,
    }
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
