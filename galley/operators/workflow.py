"""Review workflow: visibility, decisions, findings, snapshots, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galley.functions import text as tx
from galley.operators.labels import CHOICE_TYPES, FIXED_ANCHOR_TYPES
from galley.operators.revision import NEEDS_ORIGINAL, REVERTABLE
from galley.scan import prev, scan
from galley.session import stage

SNAPSHOT_LIMIT = 30
ANCHOR_WINDOW = 20


def _latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Latest row per key, by aggregation rather than a sort of each group."""
    row = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.max_by(row, by).alias("_row")).select("_row.*")


def documents_for(docs: DataFrame, users: DataFrame, role: str, user_id: int) -> DataFrame:
    """Documents a user may list: own, those of assigned students, or all."""
    if role == "student":
        return docs.where(F.col("user_id") == user_id)
    if role == "supervisor":
        mine = users.where(F.col("supervisor_id") == user_id).select("user_id")
        return docs.join(mine, "user_id", "left_semi")
    return docs


def access_check(docs: DataFrame, users: DataFrame, viewers: DataFrame) -> DataFrame:
    """Whether a viewer may open a document, for the pairs asked about.

    ``viewers(doc_id, viewer_id)``; an unknown viewer or document is refused.
    """
    owner = users.select(F.col("user_id"), F.col("supervisor_id").alias("owner_supervisor"))
    who = users.select(F.col("user_id").alias("viewer_id"), F.col("role").alias("viewer_role"))
    rows = (
        viewers.join(docs.select("doc_id", "user_id"), "doc_id", "left")
        .join(owner, "user_id", "left")
        .join(who, "viewer_id", "left")
    )
    role = F.col("viewer_role")
    allowed = (
        F.when(role == "supervisor", F.col("owner_supervisor") == F.col("viewer_id"))
        .when(role == "student", F.col("user_id") == F.col("viewer_id"))
        .otherwise(role.isin("dean", "admin") & F.col("user_id").isNotNull())
    )
    return rows.select("doc_id", "viewer_id", tx.is_true(allowed).alias("allowed"))


def unresolved_flag(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """Open findings per document and whether there are any."""
    open_ = findings.where("status = 'manual_required'").groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(open_, "doc_id", "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("unresolved"),
        (F.coalesce("n", F.lit(0)) > 0).alias("has_unresolved"),
    )


def last_comment_at(comments: DataFrame) -> DataFrame:
    return comments.groupBy("doc_id").agg(F.max("created_at").alias("last_comment_at"))


def document_listing(
    docs: DataFrame, users: DataFrame, findings: DataFrame, comments: DataFrame, versions: DataFrame | None = None
) -> DataFrame:
    """Documents with owner, open findings and last comment; newest first is the caller's sort."""
    owners = users.select("user_id", F.col("full_name").alias("owner_full_name"))
    out = (
        docs.join(owners, "user_id", "left")
        .join(unresolved_flag(docs, findings).select("doc_id", "has_unresolved"), "doc_id", "left")
        .join(last_comment_at(comments), "doc_id", "left")
    )
    if versions is not None:
        names = versions.select("version_id", F.col("name").alias("version_name"))
        out = out.join(names, "version_id", "left")
    return out


def unread_comments(last_comments: DataFrame, seen: DataFrame) -> DataFrame:
    """Documents with a comment after the reader's last visit, or never visited."""
    return (
        last_comments.where("last_comment_at IS NOT NULL")
        .join(seen, "doc_id", "left")
        .where("seen_at IS NULL OR last_comment_at > seen_at")
        .select("doc_id", "last_comment_at", "seen_at")
    )


def comment_thread(comments: DataFrame, doc_id: int | None = None) -> DataFrame:
    rows = comments if doc_id is None else comments.where(F.col("doc_id") == doc_id)
    return rows.orderBy("doc_id", "created_at")


def states_at(asked: DataFrame, users: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Role and supervisor of users at given times: ``asked(who, at)`` gives who, at, role, supervisor.

    ``changes(user_id, at, seq, role, supervisor_id)``: what holds from a time on;
    before the first change ``users`` holds. A user that neither names has no role.
    """
    asked = asked.where("who IS NOT NULL").distinct()
    stored = users.select(F.col("user_id").alias("who"), F.struct("role", "supervisor_id").alias("_stored"))
    if changes is None:
        rows = asked.withColumn("_now", F.lit(None).cast("struct<role: string, supervisor_id: bigint>"))
    else:
        known = changes.select(
            F.col("user_id").alias("who"), "at", F.lit(0).alias("_asked"), "seq",
            F.struct("role", F.col("supervisor_id").cast("long").alias("supervisor_id")).alias("_state"),
        )
        timeline = known.unionByName(asked.withColumn("_asked", F.lit(1)), allowMissingColumns=True)
        rows = scan(timeline, ["who"], ["at", "_asked", "seq"], ranged=True, _now=prev(F.col("_state"))).where("_asked = 1")
    state = F.coalesce("_now", "_stored")
    return rows.join(stored, "who", "left").select("who", "at", state["role"].alias("role"), state["supervisor_id"].alias("supervisor"))


def judge_decisions(events: DataFrame, docs: DataFrame, users: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Each workflow event with ``outcome``: done, or why it was refused.

    ``events(event_id, doc_id, action, actor_id, comment, decided_at)``. Only the
    owner submits, a processed document and with a supervisor; only staff who may
    see the document decide: the owner's supervisor, deans and admins. Roles and
    supervisors count as they were at the event (``changes``, see ``states_at``).

    A decision counts only on a pending document, so it must directly follow a
    submission (or come first on a document that is pending already); a refused
    decision changes nothing, hence the previous well-formed event decides.
    """
    rows = events.where(F.col("action").isin("submit", "approve", "reject")).join(
        docs.select("doc_id", "user_id", "status", "approval_status"), "doc_id"
    )
    asked = [rows.select(F.col(name).alias("who"), F.col("decided_at").alias("at")) for name in ("user_id", "actor_id")]
    states = stage(states_at(asked[0].unionByName(asked[1]), users, changes), "states-at")
    for name, part in (("user_id", "owner"), ("actor_id", "actor")):
        state = states.select(
            F.col("who").alias(name), F.col("at").alias("decided_at"), F.struct("role", "supervisor").alias(f"_{part}")
        )
        rows = rows.join(state, [name, "decided_at"], "left")
    owner, actor = F.col("user_id"), F.col("actor_id")
    role, supervisor = F.col("_actor.role"), F.col("_owner.supervisor")
    sees = tx.is_true(
        F.when(role == "supervisor", supervisor == actor).when(role == "student", owner == actor).otherwise(role.isin("dean", "admin"))
    )
    comment = F.nullif(tx.strip_blank(F.coalesce("comment", F.lit(""))), F.lit(""))
    submits = F.col("action") == "submit"
    form = (
        F.when(~submits & ~tx.is_true(role.isin(*STAFF)), "not_staff")
        .when((F.col("action") == "reject") & F.col("comment").isNull(), "comment_required")
        .when(~sees, "no_access")
        .when(submits & (owner != actor), "not_owner")
        .when(submits & (F.col("status") != "done"), "not_processed")
        .when(submits & supervisor.isNull(), "no_supervisor")
    )
    rows = rows.withColumn("comment", comment).withColumn("_form", form)
    rows = scan(
        rows, ["doc_id"], ["event_id"], ranged=True, _before=prev(F.when(F.col("_form").isNull(), F.col("action")))
    )
    pending = F.coalesce(F.col("_before") == "submit", F.col("approval_status") == "pending_review", F.lit(False))
    outcome = (
        F.when(F.col("_form").isNotNull(), F.col("_form"))
        .when((F.col("action") != "submit") & ~pending, "not_pending")
        .otherwise("done")
    )
    return rows.select("event_id", "doc_id", "action", "decided_at", "comment", outcome.alias("outcome"))


def review_rounds(judged: DataFrame) -> DataFrame:
    """One round per decision that counted."""
    decision = F.when(F.col("action") == "approve", "approved").otherwise("rejected")
    return judged.where("outcome = 'done' AND action <> 'submit'").select(
        "doc_id", "event_id", decision.alias("decision"), "comment", "decided_at"
    )


def approval_state(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """Approval status of every document after its events."""
    final = _latest(judged.where("outcome = 'done'"), ["doc_id"], "event_id").select(
        "doc_id", "action", F.col("comment").alias("_comment"), F.col("decided_at").alias("_at")
    )
    decided = F.col("action").isin("approve", "reject")
    return docs.select("doc_id", "approval_status").join(final, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("action") == "submit", "pending_review")
        .when(F.col("action") == "approve", "approved")
        .when(F.col("action") == "reject", "rejected")
        .otherwise(F.col("approval_status"))
        .alias("approval_status"),
        F.when(decided, F.col("_comment")).alias("approval_comment"),
        F.when(decided, F.col("_at")).alias("approval_decided_at"),
    )


def finding_actions(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Latest accept or reject per finding becomes its status: ``actions(finding_id, action, seq)``."""
    latest = actions.where(F.col("action").isin("accept", "reject")).groupBy("finding_id").agg(
        F.max_by("action", "seq").alias("_action")
    )
    status = F.when(F.col("_action") == "accept", "accepted").when(F.col("_action") == "reject", "rejected")
    return (
        findings.join(latest, "finding_id", "left")
        .withColumn("status", F.coalesce(status, F.col("status")))
        .drop("_action")
    )


def supervisor_comment(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """Set or clear the supervisor's note: ``comments(finding_id, comment, seq)``."""
    note = F.nullif(tx.strip_blank(F.coalesce("comment", F.lit(""))), F.lit(""))
    latest = comments.groupBy("finding_id").agg(F.max_by(note, "seq").alias("_note"), F.lit(True).alias("_set"))
    old = F.col("supervisor_comment") if "supervisor_comment" in findings.columns else F.lit(None).cast("string")
    return (
        findings.join(latest, "finding_id", "left")
        .withColumn("supervisor_comment", F.when(F.col("_set"), F.col("_note")).otherwise(old))
        .drop("_note", "_set")
    )


def dismiss_confirms(findings: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Accept all open heading questions on a paragraph once one of them is dismissed."""
    kinds = F.col("type").isin("heading_confirm", "possible_missed_heading")
    at = (
        findings.where(kinds & F.col("paragraph_index").isNotNull())
        .join(dismissed.select("finding_id"), "finding_id", "left_semi")
        .select("doc_id", "paragraph_index")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    status = F.when(
        tx.is_true(F.col("_hit")) & kinds & (F.col("status") == "manual_required"), "accepted"
    ).otherwise(F.col("status"))
    return findings.join(at, ["doc_id", "paragraph_index"], "left").withColumn("status", status).drop("_hit")


def cascade_renumber(conflicts: DataFrame, fixes: DataFrame) -> DataFrame:
    """New numbers of the conflicts caused by a fixed root: doc_id, paragraph_index, new_number.

    ``conflicts(doc_id, paragraph_index, caused_by_index, number)`` and
    ``fixes(doc_id, paragraph_index, number, chosen)``: root a becomes b, so a
    child keeps what its number has beyond the length of a.
    """
    roots = fixes.select("doc_id", F.col("paragraph_index").alias("caused_by_index"), F.col("number").alias("_a"), F.col("chosen").alias("_b"))
    rows = conflicts.join(roots, ["doc_id", "caused_by_index"]).where(
        (F.col("_a") != "") & (F.col("_a") != F.col("_b")) & F.col("number").isNotNull()
    )
    parts, old, new = F.split("number", r"\."), F.split("_a", r"\."), F.split("_b", r"\.")
    kept = F.slice(parts, F.size(old) + 1, F.size(parts))
    number = F.regexp_replace(F.array_join(F.concat(new, kept), "."), r"\.+$", "")
    return rows.select("doc_id", "paragraph_index", number.alias("new_number"))


def merge_recheck(findings: DataFrame, rechecked: DataFrame, docs: DataFrame) -> DataFrame:
    """Replace number conflicts of ``docs`` by re-checked ones, keeping earlier refusals.

    A new conflict stays rejected where one with the same title was rejected.
    Returns (doc_id, type, paragraph_index, section_title, status).
    """
    columns = ["doc_id", "type", "paragraph_index", "section_title", "status"]
    kind = F.col("type") == "heading_number_conflict"
    title = F.lower(tx.strip_blank(F.col("section_title")))
    refused = (
        findings.where(kind & (F.col("status") == "rejected") & (title != ""))
        .select("doc_id", title.alias("_title"))
        .distinct()
        .withColumn("_refused", F.lit(True))
    )
    new = (
        rechecked.withColumn("_title", title)
        .join(refused, ["doc_id", "_title"], "left")
        .withColumn("status", F.when(F.col("_refused"), "rejected").otherwise(F.col("status")))
    )
    others = findings.where(~kind)
    untouched = findings.where(kind).join(docs.select("doc_id"), "doc_id", "left_anti")
    return others.select(*columns).unionByName(untouched.select(*columns)).unionByName(new.select(*columns))


def replace_caption_findings(findings: DataFrame, changes: DataFrame, docs: DataFrame) -> DataFrame:
    """Replace renumbering findings of ``docs``; a change back to the source text needs none.

    ``changes(doc_id, paragraph_index, source_text, new_text)``.
    """
    kind = F.col("type") == "caption_renumbered"
    kept = findings.where(~kind).unionByName(
        findings.where(kind).join(docs.select("doc_id"), "doc_id", "left_anti")
    )
    columns = ["doc_id", "type", "status", "severity", "paragraph_index", "original_text", "fixed_text"]
    new = changes.where("source_text <> new_text").select(
        "doc_id",
        F.lit("caption_renumbered").alias("type"),
        F.lit("manual_required").alias("status"),
        F.lit("info").alias("severity"),
        "paragraph_index",
        F.col("source_text").alias("original_text"),
        F.col("new_text").alias("fixed_text"),
    )
    return kept.select(*columns).unionByName(new.select(*columns))


_GRAM = 8


def relocate_anchors(paragraphs: DataFrame, findings: DataFrame) -> DataFrame:
    """Where the heading of a finding stands now: finding_id, target (null: gone).

    ``paragraphs(doc_id, idx, norm, has_outline, is_contents)``. In order: the
    stored place if the text fits, the window around it (outline rows first),
    an outline row anywhere in the manuscript, the stored place. Texts are
    equal, or the paragraph contains a title of more than ten characters.
    Each search ends in one row per finding, found by min-by aggregation.
    """
    want = findings.select(
        "finding_id", "doc_id", "paragraph_index", tx.norm_text(F.col("section_title")).alias("title")
    )
    lines = paragraphs.where(~F.col("is_contents")).select("doc_id", "idx", "norm", "has_outline")
    fits = tx.is_true(
        (F.col("norm") == F.col("title"))
        | ((F.length("title") > 10) & F.contains(F.col("norm"), F.col("title")))
    )
    # Places come in stretches as long as the window, so a finding goes to the two that its window touches.
    stretch = 2 * ANCHOR_WINDOW + 1
    ends = F.array(*[F.floor((F.col("paragraph_index") + side) / stretch) for side in (-ANCHOR_WINDOW, ANCHOR_WINDOW)])
    near = want.where("paragraph_index IS NOT NULL").select("*", F.explode(F.array_distinct(ends)).alias("_stretch"))
    exact = F.col("idx") == F.col("paragraph_index")
    rank = (
        F.when(exact & (fits | F.col("title").isNull()), 0)
        .when(fits & F.col("has_outline"), 1)
        .when(fits, 2)
        .when(exact, 4)
    )
    # Both sides grow with the manuscripts: merge joins keep them out of the driver.
    close = (
        near.join(lines.withColumn("_stretch", F.floor(F.col("idx") / stretch)).hint("merge"), ["doc_id", "_stretch"])
        .where(F.abs(F.col("idx") - F.col("paragraph_index")) <= ANCHOR_WINDOW)
        .withColumn("rank", rank)
        .where("rank IS NOT NULL")
        .groupBy("finding_id")
        .agg(F.min(F.struct("rank", "idx")).alias("_close"))
    )
    judged = stage(want.join(close.hint("merge"), "finding_id", "left"), "close-anchors")
    # Only findings without a match nearby search the outline rows of their manuscript, each title once.
    open_ = judged.where("title IS NOT NULL AND paragraph_index IS NOT NULL AND coalesce(_close.rank, 4) = 4")
    titles = open_.groupBy("doc_id", "title").agg(F.min("finding_id").alias("_asks"))
    outline = lines.where("has_outline").groupBy("doc_id", "norm").agg(F.min("idx").alias("idx"))
    outline = stage(outline, "outline-lines")
    equal = titles.join(outline.withColumnRenamed("norm", "title").hint("merge"), ["doc_id", "title"]).select("doc_id", "title", "idx")
    far = equal.unionByName(_containing(titles.where(F.length("title") > 10), outline))
    far = far.groupBy("doc_id", "title").agg(F.min("idx").alias("_far"))
    found = open_.select("finding_id", "doc_id", "title").join(far.hint("merge"), ["doc_id", "title"])
    found = found.groupBy("finding_id").agg(F.min("_far").alias("_far"))
    return judged.join(found.hint("merge"), "finding_id", "left").select(
        "finding_id", F.coalesce("_far", "_close.idx").alias("target")
    )


def _containing(titles: DataFrame, outline: DataFrame) -> DataFrame:
    """Outline rows that contain a title: doc_id, title, idx.

    A contained title shows all its pieces of eight characters, so the pair meets on the one that the fewest rows of
    the manuscript have. Pieces travel without the text, which is fetched after the meeting.
    """
    def pieces(text: str) -> Column:
        starts = F.sequence(F.lit(1), F.length(text) - (_GRAM - 1))
        return F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(_GRAM))))).alias("_gram")

    held = outline.where(F.length("norm") >= _GRAM).select("doc_id", "idx", pieces("norm"))
    known = held.groupBy("doc_id", "_gram").agg(F.count("*").alias("_n"))
    rarest = (
        titles.select("doc_id", "_asks", pieces("title"))
        .join(known.hint("merge"), ["doc_id", "_gram"])
        .groupBy("doc_id", "_asks")
        .agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    )
    met = rarest.join(held.hint("merge"), ["doc_id", "_gram"]).select("doc_id", "_asks", "idx")
    return (
        met.join(titles.hint("merge"), ["doc_id", "_asks"])
        .join(outline.hint("merge"), ["doc_id", "idx"])
        .where(F.contains(F.col("norm"), F.col("title")))
        .select("doc_id", "title", "idx")
    )


def revertable_findings(findings: DataFrame) -> DataFrame:
    """Automatic fixes that can be undone, and whether the original file is needed."""
    return findings.where((F.col("status") == "auto_fixed") & F.col("type").isin(*REVERTABLE)).withColumn(
        "needs_original", F.col("type").isin(*NEEDS_ORIGINAL)
    )


def snapshot_append(snapshots: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Next snapshot of each requested document: (snapshots kept, new snapshots).

    ``snapshots(doc_id, snapshot_index, action_type, created_at)``,
    ``requests(doc_id, action_type, created_at)``, one per document. Of the old
    ones the newest 29 stay, so that 30 remain with the new one; the index of
    the oldest one to keep comes from a top-k per document.
    """
    from pyspark.sql import Window

    top = snapshots.groupBy("doc_id").agg(F.max("snapshot_index").alias("_max"))
    new = requests.join(top, "doc_id", "left").select(
        "doc_id",
        (F.coalesce("_max", F.lit(0)) + 1).cast("long").alias("snapshot_index"),
        "action_type",
        "created_at",
    )
    newest = Window.partitionBy("doc_id").orderBy(F.col("snapshot_index").desc())
    touched = requests.select("doc_id", F.lit(True).alias("_touched"))
    floor = (
        snapshots.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= SNAPSHOT_LIMIT - 1)
        .groupBy("doc_id")
        .agg(F.min("snapshot_index").alias("_floor"))
    )
    kept = (
        snapshots.join(floor, "doc_id")
        .join(touched, "doc_id", "left")
        .where("_touched IS NULL OR snapshot_index >= _floor")
        .select(*snapshots.columns)
    )
    return kept, new


def snapshot_findings(new_snapshots: DataFrame, findings: DataFrame) -> DataFrame:
    """Dump of the findings at each new snapshot, one row per finding.

    Rows rather than one nested array per snapshot: a document with very many
    findings stays spread over tasks.
    """
    return findings.join(new_snapshots.select("doc_id", "snapshot_index"), "doc_id")


def snapshot_list(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy("doc_id", F.col("snapshot_index").desc())


def snapshot_rollback(
    findings: DataFrame, snapshots: DataFrame, dump: DataFrame, targets: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Return to a snapshot: (findings, report counters, snapshots left).

    ``targets(doc_id, snapshot_index)``; ``dump`` as from ``snapshot_findings``.
    """
    known = targets.join(snapshots.select("doc_id", "snapshot_index"), ["doc_id", "snapshot_index"], "left_semi")
    restored = dump.join(known, ["doc_id", "snapshot_index"], "left_semi").drop("snapshot_index")
    others = findings.join(known.select("doc_id"), "doc_id", "left_anti")
    counters = known.select("doc_id").join(
        restored.groupBy("doc_id").agg(
            F.count("*").alias("total"),
            F.count_if(F.col("status") == "auto_fixed").alias("fixed"),
            F.count_if(F.col("status") == "manual_required").alias("manual"),
        ),
        "doc_id",
        "left",
    ).na.fill(0)
    limit = known.select("doc_id", F.col("snapshot_index").alias("_keep"))
    left = snapshots.join(limit, "doc_id", "left").where("_keep IS NULL OR snapshot_index <= _keep")
    return others.unionByName(restored.select(*others.columns)), counters, left.select(*snapshots.columns)


def expired_documents(docs: DataFrame, now: Column) -> DataFrame:
    return docs.where(F.col("expires_at") < now)


def purge_paths(expired: DataFrame, reports: DataFrame, path_columns: list[str]) -> DataFrame:
    """Storage paths to delete with expired documents: doc_id, path."""
    rows = expired.join(reports, "doc_id", "left")
    paths = F.array_compact(F.array(*[F.nullif(F.col(c), F.lit("")) for c in path_columns]))
    return rows.select("doc_id", F.explode(paths).alias("path"))


def latest_per_student(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``purged``: a student keeps only the newest document."""
    students = users.where("role = 'student'").select("user_id")
    newest = (
        docs.join(students, "user_id", "left_semi")
        .groupBy("user_id")
        .agg(F.max(F.struct("uploaded_at", "doc_id")).alias("_newest"))
    )
    return (
        docs.join(newest, "user_id", "left")
        .withColumn("purged", tx.is_true(F.col("_newest.doc_id") != F.col("doc_id")))
        .drop("_newest")
    )


def expires_at(docs: DataFrame, rules: dict) -> DataFrame:
    days = max(1, int((rules.get("security") or {}).get("retention_days", 90)))
    return docs.withColumn("expires_at", F.col("uploaded_at") + F.make_dt_interval(F.lit(days)))


def active_rules(versions: DataFrame) -> DataFrame:
    return versions.where("is_active")


def rule_versions(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.col("created_at").desc())


def user_list(users: DataFrame, role: str | None = None, supervisor_id: int | None = None, search: str | None = None) -> DataFrame:
    """Users by role, by supervisor, or whose name or e-mail contains the search text."""
    rows = users
    if role:
        rows = rows.where(F.col("role") == role)
    if supervisor_id is not None:
        rows = rows.where(F.col("supervisor_id") == supervisor_id)
    needle = (search or "").strip().lower()
    if needle:
        fields = [c for c in ("full_name", "email") if c in users.columns]
        rows = rows.where(tx.any_of([tx.is_true(F.lower(c).contains(needle)) for c in fields]))
    return rows


def search_documents(listing: DataFrame, query: str = "", approval: str = "all", sort: str = "date") -> DataFrame:
    """Listing filtered by approval status and text, sorted by date, name or pending first."""
    rows = listing
    if approval != "all":
        rows = rows.where(F.coalesce("approval_status", F.lit("")) == approval)
    needle = query.strip().lower()
    if needle:
        fields = [c for c in ("original_filename", "owner_full_name", "owner_email") if c in listing.columns]
        rows = rows.where(tx.any_of([tx.is_true(F.lower(c).contains(needle)) for c in fields]))
    newest = F.col("uploaded_at").desc_nulls_last()
    if sort == "name":
        return rows.orderBy("original_filename")
    if sort == "status":
        return rows.orderBy(F.when(F.col("approval_status") == "pending_review", 0).otherwise(1), newest)
    return rows.orderBy(newest)


def with_display_order(findings: DataFrame) -> DataFrame:
    """Add the three parts of the display order: group, severity, place."""
    status = F.col("status")
    choices = F.col("type").isin(*CHOICE_TYPES)
    if "fix_options" in findings.columns:
        choices = choices | (F.size(F.coalesce("fix_options", F.array().cast("array<string>"))) > 0)
    group = (
        F.when((status == "manual_required") & choices, 0)
        .when(status == "manual_required", 1)
        .when(status == "auto_fixed", 2)
        .otherwise(3)
    )
    severity = F.col("severity")
    rank = F.when(severity == "critical", 0).when(severity == "warning", 1).when(severity == "info", 2).otherwise(3)
    return findings.withColumn("order_group", group).withColumn("order_severity", rank)


def order_findings(findings: DataFrame) -> DataFrame:
    """Findings in display order: needing a choice first, then severity and place."""
    return with_display_order(findings).orderBy(
        "doc_id", "order_group", "order_severity", F.col("paragraph_index").asc_nulls_last()
    )


def group_cascades(conflicts: DataFrame) -> DataFrame:
    """Conflicts with their part in a cascade: root, child, or orphan without a root.

    A flat table with ``group_index`` instead of child lists per root, so a
    root with any number of children stays spread over tasks.
    """
    roots = (
        conflicts.where("caused_by_index IS NULL")
        .select("doc_id", F.col("paragraph_index").alias("caused_by_index"))
        .distinct()
        .withColumn("_root", F.lit(True))
    )
    part = (
        F.when(F.col("caused_by_index").isNull(), "root")
        .when(F.col("_root"), "child")
        .otherwise("orphan")
    )
    index = F.when(F.col("caused_by_index").isNull() | F.col("_root").isNull(), F.col("paragraph_index")).otherwise(
        F.col("caused_by_index")
    )
    return (
        conflicts.join(roots, ["doc_id", "caused_by_index"], "left")
        .withColumn("part", part)
        .withColumn("group_index", index)
        .drop("_root")
    )


def finding_anchor(findings: DataFrame) -> DataFrame:
    """Add ``anchor``: the text by which a finding is looked up in the document."""
    def filled(name):
        return F.nullif(tx.strip_blank(F.col(name)), F.lit(""))

    prefer = (F.col("type").isin(*FIXED_ANCHOR_TYPES) | (F.col("status") == "auto_fixed")) & filled("fixed_text").isNotNull()
    section, original = filled("section_title"), filled("original_text")
    longer = F.when(
        tx.is_true(F.length(original) > F.coalesce(F.length(section), F.lit(0))), original
    ).otherwise(section)
    return findings.withColumn("anchor", F.when(prefer, filled("fixed_text")).otherwise(longer))


def document_timeline(docs: DataFrame) -> DataFrame:
    """Events of a document in order: doc_id, step, label, happened_at."""
    status, approval = F.col("status"), F.col("approval_status")
    nothing = F.lit(None).cast("timestamp")

    def event(step, condition, label, at):
        return F.when(
            condition, F.struct(F.lit(step).alias("step"), label.alias("label"), at.alias("happened_at"))
        )

    # Names of the events.
    reviewed = (
        F.when(approval == "pending_review", "Отправлен руководителю")
        .when(approval == "approved", "Принят руководителем")
        .when(approval == "rejected", "Отклонён руководителем")
    )
    events = F.array(
        event(1, F.col("uploaded_at").isNotNull(), F.lit("Загружен"), F.col("uploaded_at")),
        event(
            2,
            status.isin("done", "error"),
            F.when(status == "done", "Обработан").otherwise("Ошибка обработки"),
            F.col("uploaded_at"),
        ),
        event(3, reviewed.isNotNull(), reviewed, nothing),
    )
    return docs.select("doc_id", F.inline(F.array_compact(events)))


STAFF = ("supervisor", "dean", "admin")


def assignment_updates(users: DataFrame, events: DataFrame) -> DataFrame:
    """Role and supervisor of every user after the events.

    ``events(seq, kind, user_id, value, actor_id)``: ``role`` sets a role,
    ``assign`` gives a student to the actor, ``unassign`` takes a student from
    the actor who holds it. Both need an actor who is staff at that time, an
    assignment also a user who is a student at that time; a later role leaves
    the supervisor as it is.
    """
    changes = events.where("kind = 'role'")
    moves = events.where(F.col("kind").isin("assign", "unassign")).join(users.select("user_id"), "user_id", "left_semi")
    nothing = F.lit(None).cast("string")

    def asked(who: str) -> DataFrame:
        return moves.select(F.col(who).alias("who"), "seq", F.lit(who).alias("part"), "kind", "user_id", "actor_id", nothing.alias("value"))

    timeline = asked("user_id").unionByName(asked("actor_id")).unionByName(
        changes.select(F.col("user_id").alias("who"), "seq", nothing.alias("part"), "value"), allowMissingColumns=True
    )
    timeline = timeline.where("who IS NOT NULL").join(
        users.select(F.col("user_id").alias("who"), F.col("role").alias("_stored")), "who"
    )
    timeline = scan(timeline, ["who"], ["seq"], ranged=True, _role=prev(F.col("value")))
    role = F.coalesce("_role", "_stored")
    judged = timeline.where("part IS NOT NULL").groupBy("user_id", "seq", "kind", "actor_id").agg(
        F.max(F.when(F.col("part") == "user_id", role)).alias("user_role"),
        F.max(F.when(F.col("part") == "actor_id", role)).alias("actor_role"),
    )
    allowed = F.col("actor_role").isin(*STAFF) & ((F.col("kind") == "unassign") | (F.col("user_role") == "student"))
    moves = judged.where(allowed).join(users.select("user_id", F.col("supervisor_id").alias("_stored")), "user_id")
    assigned = F.when(F.col("kind") == "assign", F.col("actor_id"))
    # A refused or repeated unassignment changes nothing, so the holder before an
    # event is the last assignment unless an accepted unassignment came after it.
    moves = scan(moves, ["user_id"], ["seq"], ranged=True, _holder=prev(assigned))
    holder = F.coalesce("_holder", "_stored")
    counts = (F.col("kind") == "assign") | tx.is_true(holder == F.col("actor_id"))
    final = moves.where(counts).groupBy("user_id").agg(F.max(F.struct("seq", assigned.alias("supervisor"))).alias("_last"))
    roles = changes.groupBy("user_id").agg(F.max_by("value", "seq").alias("_role"))
    return (
        users.join(roles, "user_id", "left")
        .join(final, "user_id", "left")
        .withColumn("role", F.coalesce("_role", "role"))
        .withColumn("supervisor_id", F.when(F.col("_last").isNotNull(), F.col("_last.supervisor")).otherwise(F.col("supervisor_id")))
        .drop("_last", "_role")
    )


def filter_findings(findings: DataFrame, severity: str = "all", status: str = "all") -> DataFrame:
    rows = findings
    if severity != "all":
        rows = rows.where(F.col("severity") == severity)
    if status != "all":
        rows = rows.where(F.col("status") == status)
    return rows
