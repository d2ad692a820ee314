"""Removal of repeated byte strings by suffix sorting.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts anywhere
else. To spread the suffixes over the cluster without their strings, every
window of that width is given to its anchor: the 200-byte gram in it that has
the least hash. Equal windows have equal anchors, so windows whose anchors
differ need not meet, and the windows of one anchor are the windows of one short
stretch of text.

1. Stretches that occur more than once as a whole (by a cryptographic digest of
   their bytes and the place of the anchor) are repeats in all their windows, and
   one stands for all.
2. A window reaches 100 bytes beyond its anchor on one side at least. Where an
   anchor has several different stretches, those that have such a side in common
   with another go to the anchor's shard; the others can share no window. A shard
   sorts all suffixes of its stretches by external induced sorting with
   common-prefix values; a window whose common prefix with a neighbour reaches the
   width is a repeat.
3. An anchor whose different stretches exceed ``HOT`` bytes goes to no shard: its
   windows are dealt out by their own digests, so equal ones still meet.
4. Repeated windows are carried back to every stretch like theirs, joined into
   spans of each text, and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import window_anchors
from .common import Scratch, chunks, keyed, only, sieved, text_buffer, tidy, with_keys
from .suffix_sort import repeated_windows

WIDTH = 400
GRAM = 200
#: Bytes of stretches in a shard, about.
SHARD = 4 << 20
#: Bytes of different stretches of one anchor that are still sorted in one shard.
HOT = 1 << 20
#: Bytes of queues that a shard's sort keeps in memory.
BUFFER = 32 << 20


def stretches(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """``_f``, ``_r``, the anchor's hash, ``cover`` (a digest of the stretch and the anchor's place in it),
    its first and last window, and hashes of the anchor with what is before and after it (0 if too short)."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1]
                block = raw[own[0] : own[-1]]
                text, first, last, place, anchor, before, after = window_anchors(block, own - own[0], width, gram)
                low = own[text] - own[0] + first
                buffer, size = memoryview(block.tobytes()), last - first + width
                cover = [hashlib.blake2b(buffer[i : i + n], digest_size=16, salt=p.to_bytes(8, "little")).digest() for i, n, p in zip(low.tolist(), size.tolist(), place.tolist())]
                rows = pa.array(text + a)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor.view(np.int64)), pa.array(cover, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), *(pa.array(x.view(np.int64)) for x in (before, after))]
                yield pa.RecordBatch.from_arrays(columns, names=["_f", "_r", "anchor", "cover", "first", "last", "before", "after"])

    return rows.mapInArrow(work, "_f bigint, _r bigint, anchor bigint, cover binary, first int, last int, before bigint, after bigint")


def _contents(texts: DataFrame, width: int) -> DataFrame:
    """The bytes of wanted stretches. ``texts``: text and ``wanted`` (array of anchor, cover, n, first, last)."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            lists = batch.column(1)
            wanted = lists.flatten()
            owner = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            first, last = (wanted.field(k).to_numpy() for k in (3, 4))
            low = offsets[owner] + first
            size = last - first + width
            buffer = raw.tobytes()
            parts = pa.array([buffer[a : a + n] for a, n in zip(low.tolist(), size.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([wanted.field(0), wanted.field(1), parts], names=["anchor", "cover", "content"])

    return texts.mapInArrow(work, "anchor bigint, cover binary, content binary")


def _sorted_shards(contents: DataFrame, shards: int, width: int) -> DataFrame:
    """For each stretch the windows (runs from its first, ends included) that occur elsewhere in its shard."""

    def ranges(keys: list, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p) for p in parts])
        at = np.concatenate([[0], np.cumsum(sizes + 1)])
        text = np.zeros(int(at[-1]), np.uint16)
        for a, p in zip(at.tolist(), parts):
            text[a : a + len(p)] = np.frombuffer(p, np.uint8)
            text[a : a + len(p)] += 1  # 0 stands after each stretch
        hit = repeated_windows(text, width, BUFFER)
        hit[-1] = False
        inside = np.zeros(len(text), bool)  # windows that lie in one stretch
        for a, n in zip(at.tolist(), sizes.tolist()):
            inside[a : a + n - width + 1] = True
        hit &= inside
        edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        owner = np.searchsorted(at, low, "right") - 1
        columns = [[keys[k][0] for k in owner], [keys[k][1] for k in owner], low - at[owner], high - at[owner]]
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor", "cover", "low", "high"])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, bytes]] = []
        parts: list[bytes] = []
        size = 0
        for batch in batches:  # sorted by anchor: a sort ends between two anchors
            for anchor, cover, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if size > SHARD and anchor != keys[-1][0]:
                    yield from ranges(keys, parts)
                    keys, parts, size = [], [], 0
                keys.append((anchor, cover))
                parts.append(content)
                size += len(content)
        if parts:
            yield from ranges(keys, parts)

    return contents.repartition(shards, "anchor").sortWithinPartitions("anchor").mapInArrow(work, "anchor bigint, cover binary, low int, high int")


def _digested(contents: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """For each stretch the windows (runs from its first, ends included) that occur elsewhere, by their digests."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2).to_pylist()
            counts = np.array([len(p) - width + 1 for p in parts], np.int64)
            rows = pa.array(np.repeat(np.arange(len(parts)), counts))
            at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            keys = pa.array([hashlib.md5(p[a : a + width]).digest() for p, n in zip(parts, counts.tolist()) for a in range(n)], pa.binary())
            columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "cover", "at", "key"])

    windows = scratch.write(contents.mapInArrow(work, "anchor bigint, cover binary, at int, key binary"), "digests")
    again = windows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    found = windows.join(again, "key").groupBy("anchor", "cover").agg(F.collect_list("at").alias("ats"))
    lows = "array_sort(array_except(ats, transform(ats, x -> x + 1)))"
    highs = "array_sort(array_except(ats, transform(ats, x -> x - 1)))"
    return found.select("anchor", "cover", F.expr(f"inline(arrays_zip({lows}, {highs})) as (low, high)"))


def repeated_spans(docs: DataFrame, scratch: Scratch, text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``_f``, ``_r`` and ``windows``: the runs (low, high) of windows of each row that start elsewhere too."""
    rows = keyed(docs, scratch, {"text": F.col(f"`{text}`").cast("string")}).where(F.octet_length("text") >= width)
    found = scratch.write(stretches(rows, width, gram), "stretches")
    one = [F.first(c).alias(c) for c in ("_f", "_r", "first", "last", "before", "after")]
    kinds = found.groupBy("anchor", "cover").agg(F.count(F.lit(1)).alias("n"), *one)
    many = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most")).where("kinds > 1 or most > 1")
    kinds = scratch.write(kinds.join(many, "anchor"), "kinds")
    # Whole stretches that repeat; others are sorted together with all of the same anchor that share a side.
    whole = kinds.where("n > 1").select("anchor", "cover", F.lit(0).alias("low"), (F.col("last") - F.col("first")).alias("high"))
    sides = kinds.where("kinds > 1").select("anchor", "cover", "n", F.explode(F.array("before", "after")).alias("side")).where("side <> 0")
    shared = sides.groupBy("anchor", "side").agg(F.count(F.lit(1)).alias("alike"), F.min("n").alias("least")).where("alike > 1 and least = 1").select("anchor", "side")
    partners = sides.join(shared, ["anchor", "side"]).select("anchor", "cover").distinct()
    apart = kinds.drop("kinds", "most").join(partners, ["anchor", "cover"], "left_semi")
    alike = apart.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    apart = scratch.write(apart.join(alike, "anchor"), "apart")
    size = F.col("last") - F.col("first") + width
    hot = F.col("kinds") * (2 * width - gram) > HOT  # a stretch has that many bytes at most
    totals = apart.groupBy(hot.alias("hot")).agg(F.sum(size).alias("size")).collect()
    total = {r.hot: r["size"] for r in totals}

    def contents(own: DataFrame, name: str) -> DataFrame:
        wanted = own.groupBy("_f", "_r").agg(F.collect_list(F.struct("anchor", "cover", "n", "first", "last")).alias("wanted"))
        wanted = scratch.write(wanted, name)
        texts = only(with_keys(docs, scratch).select("_f", "_r", F.col(f"row.`{text}`").cast("string").alias("text")), wanted)
        return _contents(texts.join(wanted, ["_f", "_r"]).select("text", "wanted"), width)

    shards = max(1, -(-total.get(False, 0) // SHARD))
    sorted_ = _sorted_shards(contents(apart.where(~hot), "wanted"), shards, width)
    if True in total:
        sorted_ = sorted_.unionByName(_digested(contents(apart.where(hot), "hot"), scratch, width))
    single = kinds.where("n = 1").select("anchor", "cover")
    parts = scratch.write(whole.unionByName(sorted_.join(single, ["anchor", "cover"], "left_semi")), "parts")
    # Back to all places of those stretches.
    places = found.select("_f", "_r", "anchor", "cover", "first").join(parts, ["anchor", "cover"])
    hits = places.select("_f", "_r", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    return hits.groupBy("_f", "_r").agg(F.collect_list(F.struct("low", "high")).alias("windows"))


def cut_repeats(docs: DataFrame, scratch: Scratch, text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Each row as a struct ``row``, with ``kept`` (binary: the bytes left), ``n_bytes``,
    ``n_removed`` and ``spans`` (array of start, end: what was removed, in order).

    A null text is empty. Strings are judged on the input, matches never cross
    rows, overlaps count, and rows of the same id are separate texts. Texts
    shorter than the width stay whole. An empty table gives an empty result.
    """
    windows = scratch.write(repeated_spans(docs, scratch, text, width, gram), "windows")
    marked = sieved(with_keys(docs, scratch), windows)
    content = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit("")).cast("binary")
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    clean = marked.where("not suspect").select("row", content.alias("kept"), F.octet_length(content).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), none.alias("spans"))
    rest = marked.where("suspect").select("_f", "_r", "row").join(windows, ["_f", "_r"], "left")
    rest = rest.withColumn("content", content)
    return clean.unionByName(_cut(rest.select("row", "content", "windows"), width))


def _cut(rest: DataFrame, width: int) -> DataFrame:
    """Cuts the windows of each row out of its content."""
    schema = rest.select("row", F.col("content").alias("kept")).schema
    row_type = schema["row"].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            for content, windows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own: list[dict] = []
                for w in sorted(windows or (), key=lambda w: w["low"]):
                    if own and own[-1]["end"] >= w["low"]:
                        own[-1]["end"] = max(own[-1]["end"], w["high"] + width)
                    else:
                        own.append({"start": w["low"], "end": w["high"] + width})
                at, parts = 0, []
                for s in own:
                    parts.append(content[at : s["start"]])
                    at = s["end"]
                parts.append(content[at:])
                kept.append(b"".join(parts))
                sizes.append(len(content))
                removed.append(len(content) - len(kept[-1]))
                spans.append(own)
            columns = [batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, spans_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "kept", "n_bytes", "n_removed", "spans"])

    return rest.mapInArrow(work, f"row {row_type}, kept binary, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 400 bytes. After the contract's columns ``text``:
    what is left, null where a cut went through a character."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = cut_repeats(docs, Scratch(spark, "repeats"))
    return cut.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.expr("try_validate_utf8(cast(kept as string))").alias("text"))


OP10_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS k, encode(coalesce(text, '')) AS b FROM documents
), w AS MATERIALIZED (
  SELECT k, i, md5(b[i + 1 : i + 400]) AS h FROM (SELECT k, b, unnest(range(0, octet_length(b) - 399)) AS i FROM d)
), r AS (
  SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before FROM (SELECT k, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1))
), s AS (
  SELECT k, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS g FROM r
), x AS (
  SELECT k, min(i) AS a, max(i) + 400 AS z FROM s GROUP BY k, g
), y AS (
  SELECT k, a, z, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS p, lead(a) OVER (PARTITION BY k ORDER BY a) AS q FROM x
), t AS (
  SELECT d.k, sum(z - a) AS n, count(*) AS c, string_agg(hex(b[p + 1 : a]) || CASE WHEN q IS NULL THEN hex(b[z + 1 :]) ELSE '' END, '' ORDER BY a) AS kept FROM y JOIN d ON d.k = y.k GROUP BY d.k
)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(coalesce(unhex(kept), b)) AS kept_sha256, TRY(decode(coalesce(unhex(kept), b))) AS text
FROM d LEFT JOIN t USING (k)
"""
