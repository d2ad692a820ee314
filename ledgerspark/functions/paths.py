"""Column functions over paths, identifiers and commit hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders and suffixes that decide whether a file may be recorded.
DENIED_PARTS = ("data", "raw", "output", "outputs", "cache", "logs", ".git", ".env", "_secrets", "secrets", "node_modules", "__pycache__", "0_raw", "1_output")
SAFE_SUFFIXES = (".md", ".py", ".txt")
CONTROL_PREFIXES = ("tools/", ".ledger/", ".codex/")
CONTROL_FILES = ("AGENTS.md", "GEMINI.md")
#: Longest suffix that is added to a task's id to name one of its events.
EVENT_SUFFIXES = {"begin": ":begin", "finish": ":finish", "push": ":push"}
MAX_IDENT = 160


def is_ident(value: Column) -> Column:
    return F.coalesce(F.rlike(value, F.lit(rf"\A[A-Za-z0-9_.:@-]{{1,{MAX_IDENT}}}\z")), F.lit(False))


def event_ident_fits(task: Column, event: str) -> Column:
    """Whether the id of this event of a task is still an identifier."""
    return is_ident(task) & (F.length(task) + len(EVENT_SUFFIXES[event]) <= MAX_IDENT)


def path_class(path: Column, linked: Column | None = None, outside: Column | None = None, prefixes: tuple[str, ...] = CONTROL_PREFIXES) -> Column:
    """``ok`` or the first reason to refuse a path. ``linked`` and ``outside`` are observations:
    a link on the way to it, and a target outside the root."""
    parts = F.split(path, "/")
    canonical = ~F.exists(parts, lambda x: (x == "") | (x == ".") | (x == "..") | F.rlike(x, F.lit(r"[ .]\z")))
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))
    control = path.isin(*CONTROL_FILES)
    for prefix in prefixes:
        control = control | F.startswith(path, F.lit(prefix))
    never = F.lit(False)
    return (
        F.when(path.isNull() | F.rlike(path, F.lit(r"[\\:\r\n\t|]")), F.lit("invalid_path"))
        .when(~canonical, F.lit("path_traversal"))
        .when(F.exists(parts, lambda x: F.lower(x).isin(*DENIED_PARTS)) | ~suffix.isin(*SAFE_SUFFIXES), F.lit("forbidden_file_type_or_directory"))
        .when(control, F.lit("automation_control_path"))
        .when(F.coalesce(linked if linked is not None else never, never), F.lit("symlink_or_reparse_point"))
        .when(F.coalesce(outside if outside is not None else never, never), F.lit("path_outside_root"))
        .otherwise(F.lit("ok"))
    )


def remote_head(line: Column, ref: Column) -> Column:
    """The hash in a remote's answer of one line, if it has the right shape for this ref."""
    parts = F.split(line, r"(?U)\s+")
    right = (F.size(parts) == 2) & (F.get(parts, F.lit(1)) == ref) & F.rlike(F.get(parts, F.lit(0)), F.lit(r"\A[0-9a-f]{40,64}\z"))
    return F.when(right, F.get(parts, F.lit(0)))


def remote_answer(answer: Column, ref: Column) -> Column:
    """A remote's whole answer as a struct: ``head``, or in ``error`` why it is refused."""
    lines = F.split(answer, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    head = remote_head(F.get(lines, F.lit(0)), ref)
    error = F.when(F.size(lines) != 1, F.lit("remote_branch_missing_or_ambiguous")).when(head.isNull(), F.lit("remote_branch_response_invalid"))
    return F.struct(F.when(error.isNull(), head).alias("head"), error.alias("error"))


def commit_message(app: Column, task: Column) -> Column:
    return F.concat(F.lit("research: "), app, F.lit(" task "), F.substring(task, 1, 48), F.lit("\n"))
