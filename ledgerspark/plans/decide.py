"""Decisions over recorded observations: claims, overlap, eligibility, closing a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import event_ident_fits, is_ident, path_class
from ..functions.text import has_secret, note_problem, note_shown
from ..operators.ledger import first_pending
from ..operators.path_sets import differing, paths

#: Names of the branches on which tasks may work.
BRANCH_PREFIX = "codex/"


def overlaps(tasks: DataFrame, bits: int = 20) -> DataFrame:
    """``id`` and ``overlap``: whether a task was ever active together with another.

    ``begin_seq`` and ``finish_seq`` (null while active) are places in the log.
    Two neighbours in the order of beginning decide it: one that began before
    is still open, or the next begins before this one ends. The order is cut
    into ranges of 2^bits places; a row per range carries what is still open
    from the ranges before it, so only those rows are sorted in one task.
    """
    end = F.coalesce("finish_seq", F.lit(1 << 62))
    rows = tasks.select("id", "begin_seq", end.alias("end"), F.shiftright("begin_seq", bits).alias("range"))
    ranges = rows.groupBy("range").agg(F.max("end").alias("last"), F.min("begin_seq").alias("first"))
    order = Window.orderBy("range")
    carried = ranges.select("range", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("still"), F.lead("first").over(order).alias("following"))
    own = Window.partitionBy("range").orderBy("begin_seq")
    within = rows.withColumns({"before": F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), "after": F.lead("begin_seq").over(own)})
    joined = within.join(carried, "range")
    meets = (F.greatest("before", "still") > F.col("begin_seq"), F.coalesce("after", "following") < F.col("end"))
    return joined.select("id", (F.coalesce(meets[0], F.lit(False)) | F.coalesce(meets[1], F.lit(False))).alias("overlap"))


def begin_audit(requests: DataFrame, state: DataFrame, apps: tuple[str, ...]) -> DataFrame:
    """``id`` and ``result`` of requests to begin: a refusal, ``existing`` or ``begins``.

    ``requests``: id, app, session (null: the id). ``state``: latest tasks (id,
    seq, push_status). A task that exists is answered before a pending one refuses.
    """
    pending = first_pending(state, "id", "push_status").select(F.col("error").alias("pending"))
    known = state.select("id", F.lit(True).alias("known"))
    joined = requests.join(known, "id", "left").join(F.broadcast(pending), F.lit(True), "left")
    result = (
        F.when(~is_ident(F.col("id")) | ~is_ident(F.coalesce(F.when(F.col("session") != "", F.col("session")), F.col("id"))), F.lit("invalid_identifier"))
        .when(~F.coalesce(F.col("app").isin(*apps), F.lit(False)), F.lit("unknown_app"))
        .when(F.col("known"), F.lit("existing"))
        .when(F.col("pending").isNotNull(), F.col("pending"))
        .when(~event_ident_fits(F.col("id"), "begin"), F.lit("invalid_identifier"))
        .otherwise(F.lit("begins"))
    )
    return joined.select("id", result.alias("result"))


NOTE_FIELDS = ("summary", "evidence", "remaining", "next_step")


def record_notes(requests: DataFrame) -> DataFrame:
    """``id``, ``result`` and the notes as shown. Columns: id, status and the four fields; the
    first field with a fault refuses all."""
    fault = F.coalesce(*[note_problem(F.coalesce(F.col(c), F.lit(""))) for c in NOTE_FIELDS])
    result = F.when(F.col("status") != "active", F.lit("task_not_active")).otherwise(F.coalesce(fault, F.lit("notes_recorded")))
    out = requests.withColumn("result", result)
    return out.select("id", "result", *[F.when(F.col("result") == "notes_recorded", note_shown(F.col(c))).alias(c) for c in NOTE_FIELDS])


def claim_audit(requests: DataFrame) -> DataFrame:
    """``result`` of each request: the first refusal in the order of its paths, or ``claimed``
    and then all paths of the task, sorted.

    Columns: id, status, allow, new, handoff, tracked, baseline, current (maps of
    fingerprints), claimed, asked. One refused path refuses the request.
    """

    def refusal(p: Column) -> Column:
        shape = path_class(p)
        base = F.try_element_at("baseline", p)
        return (
            F.when(shape != "ok", shape)
            .when(~F.array_contains(F.array_union("allow", "new"), p) | (p == F.col("handoff")), F.lit("path_not_explicitly_allowlisted"))
            .when(~F.coalesce(F.map_contains_key("baseline", p), F.lit(False)), F.lit("new_path_not_approved_before_begin"))
            .when(F.array_contains("new", p) & ~F.array_contains("tracked", p) & base.isNotNull(), F.lit("preexisting_untracked_file"))
            .when(~F.try_element_at("current", p).eqNullSafe(base), F.lit("claim_must_precede_edit"))
        )

    reasons = F.filter(F.transform("asked", refusal), lambda r: r.isNotNull())
    result = F.when(F.col("status") != "active", F.lit("task_not_active")).otherwise(F.coalesce(F.get(reasons, F.lit(0)), F.lit("claimed")))
    out = requests.select("id", result.alias("result"), "claimed", "asked")
    both = F.array_sort(F.array_union(F.col("claimed"), F.col("asked")))
    return out.select("id", "result", F.when(F.col("result") == "claimed", both).otherwise(F.array_sort("claimed")).alias("claimed"))


def verify(tasks: DataFrame) -> DataFrame:
    """Records a verification and the fingerprints of the claimed paths at that moment."""
    fine = (F.col("status") == "active") & F.col("value").isin("passed", "not_required", "failed", "not_run")
    shot = F.map_from_arrays("claimed", F.transform("claimed", lambda p: F.try_element_at("current", p)))
    return tasks.select("id", F.when(fine, F.col("value")).otherwise("invalid_verification").alias("verification"), F.when(fine, shot).alias("verified_snapshot"))


def eligibility(tasks: DataFrame) -> DataFrame:
    """``id``, ``error`` (a guard that aborts, with no decision), ``reason`` and ``changed`` paths.

    Columns: id, outcome, enabled, branch, head, now_branch, now_head,
    baseline_dirty, overlap, has_notes, verification, claimed, baseline,
    verified, current (maps of fingerprints, null if absent), unreadable (a
    content guard's code, or null), dirty, staged, handoff, contents (path to
    text). The first reason wins. Rows that flags alone decide never reach the
    content checks.
    """
    changed = differing(paths("claimed"), F.col("baseline"), F.col("current"))
    owned = F.array_union(changed, F.array("handoff"))
    # Paths are looked at in order: a secret before a deletion wins over it.
    faults = F.filter(
        F.transform(
            changed,
            lambda p: F.when(F.try_element_at("current", p).isNull(), F.lit("deletion_requires_manual_commit")).when(
                has_secret(F.try_element_at("contents", p)), F.lit("possible_secret")
            ),
        ),
        lambda r: r.isNotNull(),
    )
    flags = (
        F.when(F.col("outcome") != "completed", F.lit("interrupted_or_unknown"))
        .when(~F.coalesce("enabled", F.lit(False)), F.lit("paused"))
    )
    guard = F.when(~F.startswith("now_branch", F.lit(BRANCH_PREFIX)), F.lit("codex_branch_required"))
    task = (
        F.when((F.col("now_branch") != F.col("branch")) | (F.col("now_head") != F.col("head")), F.lit("head_or_branch_changed"))
        .when(F.size(paths("baseline_dirty")) > 0, F.lit("baseline_dirty"))
        .when(F.coalesce("overlap", F.lit(False)), F.lit("overlapping_tasks"))
        .when(~F.coalesce("has_notes", F.lit(False)), F.lit("handoff_notes_missing"))
        .when(~F.coalesce(F.col("verification").isin("passed", "not_required"), F.lit(False)), F.lit("verification_missing_or_failed"))
    )
    seen = tasks.withColumns({"by_flags": flags, "guard": guard, "by_task": task, "changed_paths": changed})
    content = (
        F.when(F.size(F.array_except(paths("dirty"), paths("claimed"))) > 0, F.lit("unclaimed_changes"))
        .when(~F.try_element_at("current", F.col("handoff")).eqNullSafe(F.try_element_at("baseline", F.col("handoff"))), F.lit("handoff_manual_edit"))
        .when(F.size(differing(paths("claimed"), F.col("current"), F.coalesce("verified", F.expr("cast(map() as map<string,string>)")))) > 0, F.lit("changed_after_verification"))
        .when(F.arrays_overlap(paths("staged"), owned), F.lit("user_staged_owned_path"))
        .when(F.size(faults) > 0, F.get(faults, F.lit(0)))
        .otherwise(F.lit("eligible"))
    )
    error = F.when(F.col("by_flags").isNotNull(), F.lit(None)).otherwise(F.coalesce("guard", F.when(F.col("by_task").isNull(), F.col("unreadable"))))
    out = seen.withColumn("error", error).withColumn("reason", F.when(F.col("error").isNull(), F.coalesce("by_flags", "by_task", content)))
    none = F.expr("cast(array() as array<string>)")
    return out.select("id", "error", "reason", F.when(F.col("reason") == "eligible", F.col("changed_paths")).otherwise(none).alias("changed"))


def finish(tasks: DataFrame) -> DataFrame:
    """Closing tasks: id, status, result, changed, event (id of the event to append), kind of answer.

    Columns: id, status, result, outcome, dry_run, reason, paths, error. A task
    that isn't active answers as before; a dry run and an error change nothing.
    """
    kind = (
        F.when(F.col("status") != "active", F.lit("duplicate"))
        .when(F.col("error").isNotNull(), F.lit("error"))
        .when(F.col("dry_run"), F.lit("dry_run"))
        .otherwise(F.lit("finished"))
    )
    done = F.col("kind") == "finished"
    return tasks.withColumn("kind", kind).select(
        "id",
        "kind",
        F.when(done, F.when(F.col("outcome") == "completed", F.lit("completed")).otherwise(F.lit("interrupted"))).otherwise(F.col("status")).alias("status"),
        F.when(F.col("kind") == "duplicate", F.col("result")).when(F.col("kind") == "error", F.col("error")).otherwise(F.col("reason")).alias("result"),
        F.when(done, F.col("paths")).alias("changed"),
        F.when(done, F.concat("id", F.lit(":finish"))).alias("event"),
    )
