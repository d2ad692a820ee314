"""The bounded report and the status view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import most_recent
from ..operators.path_sets import paths

STATUS_FIELDS = ("id", "app", "status", "result", "commit", "claimed", "verification", "push_status", "push_error", "remote_commit", "push_verified_at")


def report_lines(tasks: DataFrame) -> DataFrame:
    """``pos`` and ``line``: a table row for each of the 12 tasks that started last, then the
    notes of those that have any, in the same order.

    Columns: seq, id, app, started, status, result, verification, changed,
    claimed, push_error, notes (struct or null). An empty list falls through to
    the next, then to a dash.
    """
    top = most_recent(tasks, F.desc("started"), F.desc("seq"))
    ranked = top.select(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("started").cast("timestamp"))).alias("s"), (-F.col("seq")).alias("q"), F.struct(*[f"`{c}`" for c in tasks.columns]).alias("t")))).alias("rows"))
    rows = ranked.select(F.posexplode("rows").alias("pos", "row")).select("pos", "row.t.*")
    names = F.when(F.size(paths("changed")) > 0, F.col("changed")).when(F.size(paths("claimed")) > 0, F.col("claimed"))
    files = F.coalesce(F.array_join(names, ", "), F.lit("—"))
    push = F.when(F.coalesce("push_error", F.lit("")) != "", F.concat(F.lit(" / "), "push_error")).otherwise("")
    start = F.date_format(F.col("started").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    table = F.concat(F.lit("| "), start, F.lit(" | "), "app", F.lit(" | `"), "id", F.lit("` | "), "status", F.lit(" / "), "result", push, F.lit(" | "), "verification", F.lit(" | "), files, F.lit(" |"))
    notes = F.array(
        F.lit(""),
        F.concat(F.lit("**"), "app", F.lit(" / "), "id", F.lit("**")),
        *[F.concat(F.lit(f"- {k}: "), F.col(f"notes.{k}")) for k in ("summary", "evidence", "remaining", "next_step")],
    )
    table_rows = rows.select(F.lit(0).alias("part"), "pos", F.lit(0).alias("k"), table.alias("line"))
    note_rows = rows.where("notes is not null").select(F.lit(1).alias("part"), "pos", F.posexplode(notes).alias("k", "line"))
    return table_rows.unionByName(note_rows).select((F.col("part") * 1000 + F.col("pos") * 10 + F.col("k")).alias("pos"), "line")


def status(tasks: DataFrame) -> DataFrame:
    """The 12 tasks saved last, eleven fields each, as JSON with nulls kept."""
    top = most_recent(tasks, F.desc("seq"))
    return top.select("seq", *STATUS_FIELDS, F.to_json(F.struct(*STATUS_FIELDS), {"ignoreNullFields": "false"}).alias("json"))


def status_document(tasks: DataFrame, meta: DataFrame, policy: DataFrame, root: str) -> DataFrame:
    """The whole status, one row: ``enabled`` (false unless set), ``expected_root``, ``push_policy``,
    ``tasks`` (the 12 saved last, eleven fields each, latest first) and ``commit_journal``.

    ``meta``: key and value (JSON), a row per key; ``policy``: one row with a struct ``push``, null if off.
    """
    own = meta.groupBy().agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("enabled", "commit_journal")])
    top = status(tasks).select(F.struct("seq", F.struct(*STATUS_FIELDS).alias("task")).alias("t"))
    last = top.groupBy().agg(F.transform(F.sort_array(F.collect_list("t"), asc=False), lambda t: t["task"]).alias("tasks"))  # 12 at most
    push = policy.select(F.coalesce("push", F.struct(F.lit(False).alias("enabled"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("branch"))).alias("push_policy"))
    journal = F.when(F.col("commit_journal") != "null", F.col("commit_journal"))
    row = own.join(push, F.lit(True)).join(last, F.lit(True))  # a row each
    return row.select(F.coalesce(F.col("enabled") == "true", F.lit(False)).alias("enabled"), F.lit(root).alias("expected_root"), "push_policy", "tasks", journal.alias("commit_journal"))
