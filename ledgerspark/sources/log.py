"""The append-only log: each save is a row, in the order of ``seq``; nothing is rewritten."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the log of each kind holds besides ``seq``: settings, saves of tasks (the body as JSON), events.
LOGS = {
    "meta": "key string, value string",
    "tasks": "id string, session string, app string, started string, status string, body string",
    "events": "id string, at timestamp, task string, event string, result string",
}


def read_log(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """``seq`` and the columns of every save; no rows where nothing was saved yet."""
    schema = f"seq bigint, {columns}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_log(rows: DataFrame, path: str, columns: str) -> None:
    """Adds saves after all that are there, in the order of the frame. One writer at a time.

    ``seq`` grows with that order but has gaps: partitions count for themselves, so that no
    task sees all rows."""
    last = read_log(rows.sparkSession, path, columns).agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    names = [c.split()[0] for c in columns.split(", ")]
    rows.select((F.lit(last) + F.monotonically_increasing_id()).alias("seq"), *names).write.mode("append").parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, deleted at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerspark-")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def delete() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended
            pass

    atexit.register(delete)
    return folder
