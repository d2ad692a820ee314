"""Audits of a publication over recorded observations, and the state they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_FILE_BYTES, has_secret
from ..functions.paths import path_class
from ..operators.path_sets import joined, paths, same_set

#: Settings that may not exist, and the shape of address rewrites.
FORBIDDEN_SETTINGS = ("remote.origin.pushurl", "remote.origin.push", "remote.origin.mirror", "remote.origin.receivepack", "remote.pushdefault")
REWRITE = r"^url\..*\.(insteadof|pushinsteadof)$"
#: Fixed value: attributes that a recorded file must have.
ATTRIBUTES = {"text": "set", "eol": "lf", "filter": "unspecified", "working-tree-encoding": "unspecified"}


def destination_audit(observed: DataFrame) -> DataFrame:
    """``result`` per observation. Columns: id, enabled, push_enabled, root, url, branch (of
    the policy), own_root, own_url, own_branch (authorised), remotes, urls, settings (names)."""
    result = (
        F.when(~F.coalesce("enabled", F.lit(False)) | ~F.coalesce("push_enabled", F.lit(False)), F.lit("push_paused"))
        .when(~(F.col("root").eqNullSafe(F.col("own_root")) & F.col("url").eqNullSafe(F.col("own_url")) & F.col("branch").eqNullSafe(F.col("own_branch"))), F.lit("push_destination_not_authorized"))
        .when(~F.col("remotes").eqNullSafe(F.array(F.lit("origin"))), F.lit("unexpected_remote_set"))
        .when(~F.col("urls").eqNullSafe(F.array("own_url")), F.lit("unexpected_origin_url"))
        .when(F.exists(paths("settings"), lambda s: s.isin(*FORBIDDEN_SETTINGS)), F.lit("unexpected_push_config"))
        .when(F.exists(paths("settings"), lambda s: F.rlike(s, F.lit(REWRITE))), F.lit("url_rewrite_or_config_error"))
        .otherwise(F.lit("authorized"))
    )
    return observed.select("id", result.alias("result"))


def publication_audit(observed: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """``raised`` (the request is refused, nothing is recorded), else ``result``: the first
    failure, or ``send`` / ``already_there``.

    Columns: id, status, commit, push_status, destination, own_branch,
    now_branch, now_head, branch, head, any_active, ancestry, changed, handoff,
    actual, allowed, contents (path to text), remote, after (remote head after
    sending).
    """
    raised = (
        F.when((F.col("status") != "completed") | (F.coalesce("commit", F.lit("")) == ""), F.lit("task_has_no_completed_commit"))
        .when(~F.coalesce(F.col("push_status").isin("pending", "failed", "unknown", "verified"), F.lit(False)), F.lit("task_created_without_push_authorization"))
    )
    expected = joined(paths("changed"), F.array("handoff"))
    faults = F.filter(
        F.transform(
            F.array_sort(F.array_distinct("actual")),
            lambda p: F.when(path_class(p) != "ok", path_class(p))
            .when(~F.array_contains(F.array_union("allowed", F.array("handoff")), p), F.lit("push_path_no_longer_authorized"))
            .when((F.octet_length(F.try_element_at("contents", p)) > limit) | has_secret(F.try_element_at("contents", p)), F.lit("push_unsafe_content")),
        ),
        lambda r: r.isNotNull(),
    )
    result = (
        F.when(F.col("destination") != "authorized", F.col("destination"))
        .when(~((F.col("now_branch") == F.col("own_branch")) & (F.col("now_head") == F.col("commit")) & (F.col("branch") == F.col("now_branch"))), F.lit("push_head_or_branch_changed"))
        .when(F.col("any_active"), F.lit("push_has_active_task"))
        .when(~F.col("ancestry").eqNullSafe(F.array("now_head", "head")), F.lit("push_unauthorized_ancestry"))
        .when(~same_set(F.col("actual"), expected), F.lit("push_unauthorized_paths"))
        .when(F.size(faults) > 0, F.get(faults, F.lit(0)))
        .when(~F.col("remote").isin(F.col("head"), F.col("now_head")), F.lit("push_remote_not_task_baseline"))
        .when((F.col("push_status") == "verified") & (F.col("remote") != F.col("now_head")), F.lit("push_previously_verified_remote_changed"))
        .when(~F.col("after").eqNullSafe(F.col("now_head")), F.lit("push_remote_verification_mismatch"))
        .when(F.col("remote") == F.col("now_head"), F.lit("already_there"))
        .otherwise(F.lit("send"))
    )
    return observed.select("id", raised.alias("raised"), F.when(raised.isNull(), result).alias("result"))


def publication_state(tasks: DataFrame) -> DataFrame:
    """The state after an audit. Columns: id, push_status, push_attempts, commit, remote, audit
    (an audit's result). Attempts count sending only; a verified publication stays verified."""
    fine = F.col("audit").isin("send", "already_there")
    sent = (F.col("audit") == "send") | (F.col("audit") == "push_remote_verification_mismatch") & ~F.col("remote").eqNullSafe(F.col("commit"))
    held = ~fine & (F.col("push_status") == "verified") & ~sent
    return tasks.select(
        "id",
        F.when(fine, F.lit("pushed")).when(held, F.lit("retry_refused")).otherwise(F.lit("push_failed")).alias("result"),
        F.when(fine | held, F.lit("verified")).otherwise(F.lit("failed")).alias("push_status"),
        (F.coalesce("push_attempts", F.lit(0)) + sent.cast("int")).alias("push_attempts"),
        F.when(~fine, F.col("audit")).alias("push_error"),
        F.when(fine, F.col("commit")).alias("remote_commit"),
    )


def journal_gate(commands: DataFrame) -> DataFrame:
    """Which commands may run while a commit journal is open. Columns: command, journal."""
    shut = (F.coalesce("journal", F.lit("null")) != "null") & ~F.col("command").isin("status", "pause", "disable")
    return commands.select("command", "journal", F.when(shut, F.lit("unresolved_commit_journal_requires_review")).otherwise(F.lit("ok")).alias("result"))


def commit_preconditions(observed: DataFrame) -> DataFrame:
    """The first reason not to assemble a commit, or ``ok``. Columns: id, contents (path to text
    or null), index_locked, now_branch, now_head, branch, head, staged, paths, attributes (map of
    the odd ones found per path), modes, files_after_same, index_after_same."""
    right = F.create_map(*[F.lit(x) for kv in ATTRIBUTES.items() for x in kv])
    odd = F.exists("attributes", lambda a: F.array_sort(F.map_entries(a)) != F.array_sort(F.map_entries(right)))
    result = (
        F.when(F.exists(F.map_values("contents"), lambda t: t.isNull() | F.coalesce(has_secret(t), F.lit(False))), F.lit("unsafe_commit_content"))
        .when(F.col("index_locked"), F.lit("git_index_busy"))
        .when((F.col("now_branch") != F.col("branch")) | (F.col("now_head") != F.col("head")), F.lit("head_or_branch_changed"))
        .when(F.arrays_overlap(paths("staged"), paths("paths")), F.lit("user_staged_owned_path"))
        .when(odd, F.lit("unsupported_git_attributes"))
        .when(F.exists("modes", lambda m: ~m.isin("100644", "100755")), F.lit("non_regular_git_entry"))
        .when(~F.col("files_after_same"), F.lit("files_changed_during_commit"))
        .when(~F.col("index_after_same"), F.lit("index_changed_during_commit"))
        .otherwise(F.lit("ok"))
    )
    return observed.select("id", result.alias("result"))
