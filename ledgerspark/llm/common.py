"""What the operators share: scratch tables, row keys, and text as byte arrays.

Scratch tables live in the folder that ``spark.checkpoint.dir`` names, which
every executor can read; a folder of our own is made only where that setting
is missing and Spark runs in this process (tests). They replace lineage, so a
lost executor costs a re-read.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of word separators in the contracts: space and tab to carriage return.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="ledgerspark-"))
    return _own_folder[0]


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a path of any Hadoop file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def trim() -> None:
    """Gives unused native memory of this Python process back to the system."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if give_back:
        give_back(0)


def trim_jvm(spark: SparkSession) -> None:
    """Does the same in the driver's JVM, whose allocator keeps what hundreds of short-lived threads have freed.

    By reflection, since the bean server's class can't be called from outside; nothing happens in a JVM without that command.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    arguments = gateway.new_array(jvm.Object, 4)
    arguments[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    arguments[1] = "systemTrimNativeHeap"
    arguments[2], arguments[3] = gateway.new_array(jvm.Object, 0), gateway.new_array(jvm.String, 0)
    methods = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods()
    invoke = next(m for m in methods if m.getName() == "invoke")
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JJavaError:
        pass


def release(spark: SparkSession) -> None:
    """Frees what earlier runs left on the driver: plans, their broadcasts (on executors too), generated classes and native memory."""
    gc.collect()
    trim()
    spark._jvm.System.gc()
    trim_jvm(spark)


#: Arrow batches while scratch tables are written: of few rows and bytes, so that long texts don't pile up in workers.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside and are what they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_scopes: list[list[Scratch]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """At its end, deletes the tables of every ``Scratch`` made inside; what is still wanted must be written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        for scratch in _scopes.pop():
            scratch.close()


class Scratch:
    """Tables of one operator run in the shared folder, deleted at exit or by ``drop``."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        release(spark)
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.inputs: list[tuple[DataFrame, DataFrame]] = []
        atexit.register(self._clear)
        if _scopes:
            _scopes[-1].append(self)

    def _clear(self) -> None:
        try:
            delete_path(self.spark, self.base)
        except Exception:  # the session has ended
            pass

    def close(self) -> None:
        """Deletes all tables at once."""
        self.inputs.clear()
        delete_path(self.spark, self.base)
        atexit.unregister(self._clear)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with settings(self.spark, SMALL_BATCHES):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def table_of(self, df: DataFrame) -> DataFrame:
        """``df`` as a table, written once however often it is asked for."""
        for known, table in self.inputs:
            if known is df:
                return table
        self.inputs.append((df, self.write(df, f"input-{len(self.inputs)}")))
        return self.inputs[-1][1]

    def drop(self, name: str) -> None:
        delete_path(self.spark, self.path(name))


def keyed(docs: DataFrame, scratch: Scratch, columns: dict[str, Column]) -> DataFrame:
    """``columns`` of each row, after ``_f`` and ``_r``, which name the row for good.

    They are a hash of the row's file and its index there, so every scan of the
    same files gives the same keys, whatever else the table holds (ids may be
    null or repeat). Frames that aren't plain file scans are written first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = scratch.table_of(docs)
    return docs.select(
        F.xxhash64("_metadata.file_path").alias("_f"),
        F.col("_metadata.row_index").alias("_r"),
        *[c.alias(n) for n, c in columns.items()],
    )


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true inside the ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: True for bytes outside space and tab to carriage return.
IN_WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and len + 1 offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4))
    first, last = (int(ends[0]), int(ends[-1])) if len(column) else (0, 0)
    raw = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, ends.astype(np.int64) - first


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``most`` bytes; a longer row stands alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, for work that makes Python objects of each."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives unused memory of its Python worker back at the end of a task; workers live on."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


#: Rows of a sieve, at least and at most; each holds 64 bits. Its size follows its members' number
#: up to that bound (a broadcast of some 32 MB); with more members than bits there is no sieve.
SIEVE_WORDS = (1 << 16, 1 << 20)


def with_keys(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Each whole row as a struct ``row`` (so that no column name can clash), with its key."""
    return keyed(docs, scratch, {"row": F.struct(*[f"`{c}`" for c in docs.columns])})


def sieved(rows: DataFrame, members: DataFrame) -> DataFrame:
    """``rows`` with ``suspect``: false for most rows whose key is not among ``members``.

    The members (a table that is cheap to count) are hashed onto 4 to 64 million
    bits. It spares rows with long texts a shuffle; a join on the key decides.
    """
    n, (words, most) = members.count(), SIEVE_WORDS
    if n > 64 * most:
        return rows.withColumn("suspect", F.lit(True))
    while words < most and 4 * words < n:
        words *= 2
    hashed = F.xxhash64("_f", "_r")
    word, bit = F.shiftrightunsigned(hashed, 6).bitwiseAND(F.lit(words - 1)), F.pmod(hashed, F.lit(64)).cast("int")
    bits = members.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    marked = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word", "left")
    suspect = F.expr("coalesce(shiftright(_bits, _bit) & 1L, 0L)") == 1
    return marked.withColumn("suspect", suspect).drop("_word", "_bit", "_bits")


def only(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows whose key is among ``members``."""
    return sieved(rows, members).where("suspect").drop("suspect").join(members.select("_f", "_r"), ["_f", "_r"], "left_semi")


def without(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows whose key is not among ``members``; only suspects are shuffled."""
    marked = sieved(rows, members)
    rest = marked.where("suspect").join(members.select("_f", "_r"), ["_f", "_r"], "left_anti")
    return marked.where(~F.col("suspect")).select(*rows.columns).unionByName(rest.select(*rows.columns))


#: Keys that occur most often, whose rows are not shuffled in ``join_groups``.
HOT_KEYS = 256


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` joined to ``groups`` (a row per key, ``n`` rows each), on ``key`` without nulls.

    One key may hold a third of all rows. The groups of the ``HOT_KEYS`` greatest counts are
    broadcast, so their rows stay where they are; only those of other keys are shuffled, at every
    size of ``groups``, which grow with the data. Both sides are read twice and should be tables.
    """
    hot = groups.where(F.col(n) > 1).orderBy(F.desc(n), key).limit(HOT_KEYS)  # ties by key: it is evaluated twice
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    rest = marked.where("_hot is null").select(*rows.columns).join(groups.hint("merge"), key)
    return marked.where("_hot").select(*rest.columns).unionByName(rest)
