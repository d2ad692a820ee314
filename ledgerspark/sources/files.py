"""Readers and writers: policy files, folders of text files, and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MAX_FILE_BYTES

POLICY = (
    "expected_root string, handoff string, tracked_paths array<string>, approved_new_paths array<string>, "
    "max_file_bytes bigint, push struct<enabled: boolean, url: string, branch: string>"
)
#: The body of a task, as each save of the log holds it.
TASK = (
    "id string, app string, session string, started string, status string, branch string, head string, "
    "baseline map<string,string>, baseline_dirty array<string>, claimed array<string>, overlap boolean, "
    "verification string, result string, notes struct<summary: string, evidence: string, remaining: string, next_step: string>, "
    "verified_snapshot map<string,string>, changed array<string>, commit string, remote_commit string, push_error string, "
    "push_status string, push_attempts int, push_verified_at string"
)


def policy_fields(policy: DataFrame, root: str) -> DataFrame:
    """Defaults filled in, and ``error`` where the policy is for another root."""
    none = F.expr("cast(array() as array<string>)")
    return policy.select(
        F.when(~F.col("expected_root").eqNullSafe(F.lit(root)), F.lit("expected_root_mismatch")).alias("error"),
        "handoff",
        "tracked_paths",
        F.coalesce("approved_new_paths", none).alias("approved_new_paths"),
        F.coalesce("max_file_bytes", F.lit(MAX_FILE_BYTES)).cast("long").alias("max_file_bytes"),
        F.coalesce("push.enabled", F.lit(False)).alias("push_enabled"),
    )


def read_policy(spark: SparkSession, path: str, root: str) -> DataFrame:
    return policy_fields(spark.read.schema(POLICY).json(path, multiLine=True), root)


def read_texts(spark: SparkSession, folder: str, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """``path``, ``text`` (byte order mark dropped) and ``error`` of every file below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    bytes_ = F.col("content")
    marked = F.startswith(bytes_, F.lit(b"\xef\xbb\xbf"))
    body = F.when(marked, F.substring(bytes_, 4, 1 << 30)).otherwise(bytes_)
    error = (
        F.when(F.col("length") > limit, F.lit("file_too_large_or_not_regular"))
        .when(~F.is_valid_utf8(bytes_.cast("string")), F.lit("ValueError"))
        .when(F.contains(bytes_, F.lit(b"\0")), F.lit("binary_file"))
    )
    return raw.select("path", F.when(error.isNull(), body.cast("string")).alias("text"), error.alias("error"))


def write_report(lines: DataFrame, path: str) -> bool:
    """Writes a report of few lines, only if it differs from what is there; true if written."""
    from pathlib import Path

    target = Path(path)
    text = "\n".join(r.line for r in lines.orderBy("pos").select("line").collect()) + "\n"
    if target.exists() and target.read_text(encoding="utf-8") == text:
        return False
    fresh = target.with_name(target.name + ".new")
    fresh.write_text(text, encoding="utf-8")
    fresh.replace(target)
    return True
