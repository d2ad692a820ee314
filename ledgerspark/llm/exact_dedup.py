"""Exact deduplication by a streaming query with disk-backed keyed state.

A stream reads every row's digest, stable identifier and content locator and
keeps them in a RocksDB state store, keyed by the digest, without expiry: for
each digest the number of rows and the row that stays. Wherever a digest was hit
more than once, the full texts are compared; should they differ, those digests
are split by the texts themselves. Everything runs on DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, join_groups, keyed, only, settings, with_keys, without

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every partition's store claims megabytes ahead
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # stores of a query that has ended are closed then
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _state(keys_path: str, keys: DataFrame, scratch: Scratch, bytes_per_batch: str | None, folder: str | None) -> DataFrame:
    """One row per digest: n and the struct ``keep`` (doc_id and locator of the row that stays)."""
    spark = keys.sparkSession
    source = spark.readStream.schema(keys.schema)
    if bytes_per_batch:
        source = source.option("maxBytesPerTrigger", bytes_per_batch)
    held = (
        source.parquet(keys_path)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "_f", "_r")).alias("keep"))
    )
    batches: list[str] = []

    def put(updated: DataFrame, batch: int) -> None:
        """A batch that runs again after a failure replaces its own rows."""
        path = f"{folder or scratch.base}/updates/batch={batch}"
        updated.write.mode("overwrite").parquet(path)
        if path not in batches:
            batches.append(path)

    with settings(spark, STATE):
        query = (
            held.writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", f"{folder or scratch.base}/state").foreachBatch(put).start()
        )
        query.awaitTermination()
    schema = "digest binary, n bigint, keep struct<doc_id: bigint, _f: bigint, _r: bigint>"
    if folder:
        updates = spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/updates").drop("batch")
    else:
        scratch.drop("state")
        if not batches:
            return spark.createDataFrame([], schema)
        updates = spark.read.schema(schema).parquet(*batches)
        if len(batches) == 1:
            return updates
    return updates.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("last")).select("digest", "last.n", "last.keep")


def exact_groups(
    docs: DataFrame,
    scratch: Scratch,
    text: str = "text",
    ident: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
    bytes_per_batch: str | None = None,
    state: str | None = None,
) -> DataFrame:
    """For each row of ``docs``: ``_f``, ``_r``, ``doc_id``, ``digest``, ``n`` and ``keep``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest id stays, a null id being smallest; of rows with
    that same id the one with the largest key stays, so exactly one does. An
    empty table gives an empty result.

    ``state``: a folder that keeps state and digests between calls; rows are then
    also equal to those of earlier calls, which count in ``n`` and may be ``keep``.
    Texts of earlier calls are compared by their digests only, those of this call in full.
    """
    content = F.coalesce(ascii_lower(F.col(f"`{text}`").cast("string")), F.lit(""))
    keys = scratch.write(keyed(docs, scratch, {"doc_id": F.col(f"`{ident}`").cast("long"), "digest": digest(content)}), "keys")
    if state:
        keys.write.mode("append").parquet(f"{state}/keys")
    groups = _state(f"{state}/keys" if state else scratch.path("keys"), keys, scratch, bytes_per_batch, state)
    rows = join_groups(keys, groups, "digest").select("_f", "_r", "doc_id", "digest", "n", "keep")
    rows = scratch.write(rows, "rows")

    hits = rows.where("n > 1").select("_f", "_r", "digest")
    texts = only(with_keys(docs, scratch).select("_f", "_r", F.coalesce(ascii_lower(F.col(f"row.`{text}`").cast("string")), F.lit("")).alias("content")), hits)
    texts = texts.withColumn("digest", digest(F.col("content")))
    clashes = texts.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high").select("digest")
    clashes = scratch.write(clashes, "clashes")
    if clashes.isEmpty():
        return rows
    # Different texts share a digest: their rows are grouped by the texts.
    apart = texts.join(clashes, "digest", "left_semi").join(keys.select("_f", "_r", "doc_id"), ["_f", "_r"])
    split = apart.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "_f", "_r")).alias("keep"))
    fixed = apart.join(split, ["digest", "content"]).select("_f", "_r", "doc_id", "digest", "n", "keep")
    return rows.join(clashes, "digest", "left_anti").select(*fixed.columns).unionByName(fixed)


#: Whether the row itself is the one that stays.
KEPT = "keep._f = _f and keep._r = _r"


def drop_copies(docs: DataFrame, scratch: Scratch, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose equal stays."""
    dropped = scratch.write(exact_groups(docs, scratch, text, ident).where(f"not ({KEPT})").select("_f", "_r"), "dropped")
    return without(with_keys(docs, scratch), dropped).select("row.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the equal that stays in its place."""
    groups = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "exact"))
    return groups.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.expr(KEPT).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
