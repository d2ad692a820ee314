"""Near-duplicates by MinHash: minima, bands, verification, components.

1. Every text's set of hashed shingles gives ``BANDS * ROWS`` minima of
   universal hash functions. Texts with equal sets (by a digest of the whole set)
   are one class from here on, so groups of copies are never paired.
2. Classes that agree in a band meet in a bucket. Every class is paired with the
   least class that it meets: at most one pair each.
3. Pairs pass if their sizes allow the similarity and the low bits of their
   minima agree often enough, and are then confirmed on the full sets. Links
   make components.
4. Only where a bucket still holds several components are members of different
   ones compared, all of them, so no link that a bucket holds is lost to step 2.
   Cells of bounded size compare signatures first; those outside the bucket's
   greatest component meet all members. The full sets go only to the members that
   have a partner there, and the cells then pass on nothing but confirmed links
   that join two components. Then components are made again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, chunks, join_groups, keyed, only, text_buffer, tidy, with_keys, without
from .components import components
from .shingles import U, mixed, shingle_sets

BANDS = 32
ROWS = 4
WORDS = 5
#: Similarity in hundredths.
PERCENT = 80
SEED = 20240607
#: Members of a bucket on either side of a cell, and shingles of their sets, about.
CELL = 1024
CELL_SHINGLES = 1 << 21
#: Of 128 low bits of minima, those that may differ: at similarity 0.8 about 13
#: do, and more than 36 with a chance below 4 in 100 million (Chernoff's bound).
MOST_BITS = 36
#: Of 128 low bytes of minima, those that must agree: at similarity 0.8 about 102
#: do, and less than 74 with a chance below 8 in 100 million (Chernoff's bound).
LEAST_BYTES = 74


def hash_functions(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of n universal multiply-shift hash functions."""
    random = np.random.Generator(np.random.PCG64(seed))
    a = random.integers(0, np.iinfo(U).max, n, dtype=U)
    return a | U(1), random.integers(0, np.iinfo(U).max, n, dtype=U)


def minima(hashes: np.ndarray, ends: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each hash function over each non-empty set, one row a set (uint32)."""
    starts = np.concatenate([[0], ends[:-1]])
    full = ends > starts
    out = np.zeros((len(ends), len(functions[0])), np.uint32)
    if full.any():
        at = starts[full]
        for k, (a, b) in enumerate(zip(*functions)):
            out[full, k] = np.minimum.reduceat(((hashes * a + b) >> U(32)).astype(np.uint32), at)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each row."""
    rows = least.reshape(len(least), BANDS, ROWS).astype(U)
    key = np.zeros(rows.shape[:2], U)
    for j in range(ROWS):
        key = mixed(key * U(0x9E3779B97F4A7C15) + rows[:, :, j] + U(j + 1))
    return key.view(np.int64)


def signatures(docs: DataFrame, scratch: Scratch, text: str, ident: str, words: int) -> DataFrame:
    """Per row: key, doc_id, n_shingles, a digest of the set, the low bits and bytes of its minima, its band keys."""
    functions = hash_functions(BANDS * ROWS)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(3))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1]
                hashes, ends = shingle_sets(raw[own[0] : own[-1]], own - own[0], words)
                least = minima(hashes, ends, functions)
                sizes = np.diff(np.concatenate([[0], ends]))
                packed, at = hashes.tobytes(), [0, *(ends * 8).tolist()]
                digests = [hashlib.blake2b(packed[i:j], digest_size=16).digest() for i, j in zip(at, at[1:])]
                bits = np.packbits((least & 1).astype(np.uint8), axis=1).view(np.int64).reshape(len(least), 2)
                low = least.astype(np.uint8).tobytes()
                low = [low[i : i + least.shape[1]] for i in range(0, len(low), least.shape[1])]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(least) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(least).ravel()))
                own_columns = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *(pa.array(bits[:, k], pa.int64()) for k in (0, 1)), pa.array(low, pa.binary()), keys]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), *own_columns], names=["_f", "_r", "doc_id", "n_shingles", "same", "bits1", "bits2", "low", "bands"])

    schema = "_f bigint, _r bigint, doc_id bigint, n_shingles bigint, same binary, bits1 bigint, bits2 bigint, low binary, bands array<bigint>"
    rows = keyed(docs, scratch, {"doc_id": F.col(f"`{ident}`").cast("long"), "text": F.col(f"`{text}`").cast("string")})
    return rows.mapInArrow(work, schema).withColumn("node", F.monotonically_increasing_id())


def _full_sets(docs: DataFrame, scratch: Scratch, wanted: DataFrame, text: str, words: int) -> DataFrame:
    """``node`` and its shingle set (sorted hashes, packed) of the wanted rows."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1]
                hashes, ends = shingle_sets(raw[own[0] : own[-1]], own - own[0], words)
                packed, at = hashes.tobytes(), [0, *(ends * 8).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([packed[i:j] for i, j in zip(at, at[1:])], pa.binary())], names=["node", "shingles"])

    rows = only(with_keys(docs, scratch).select("_f", "_r", F.col(f"row.`{text}`").cast("string").alias("text")), wanted)
    return rows.join(wanted.select("_f", "_r", "node"), ["_f", "_r"]).select("node", "text").mapInArrow(work, "node bigint, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(s.as_buffer(), U) for s in (x, y))
                shared = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["u", "v"])

    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(work, "u bigint, v bigint")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell (the first four columns), which come one cell after another."""
    cell, parts = None, []
    for batch in batches:
        if not len(batch):
            continue
        at = np.stack([batch.column(k).to_numpy() for k in range(4)], 1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if tuple(at[a]) != cell:
                if parts:
                    yield pa.Table.from_batches(parts)
                cell, parts = tuple(at[a]), []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


class _Cell:
    """The members of one cell: ``down`` its rows, ``across`` its columns."""

    def __init__(self, table: pa.Table, percent: int) -> None:
        column = lambda k: table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
        self.node, self.size, self.outside, row = map(column, ("node", "n_shingles", "outside", "row"))
        self.component = np.unique(column("root"), return_inverse=True)[1]
        self.low = text_buffer(table.column("low"))[0].reshape(len(row), -1)
        self.bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(row), -1)
        self.band = table.column("band")[0].as_py()
        self.down, self.across, self.percent = np.flatnonzero(row), np.flatnonzero(~row), percent

    def partners(self, i: int) -> np.ndarray:
        """Members of other components across that may be similar enough to one down. Of two
        outsiders one meets the other, and a pair is left to the first band in which it agrees."""
        j = self.across[self.component[self.across] != self.component[i]]
        j = j[~self.outside[j] | (self.node[j] > self.node[i])]
        j = j[100 * np.minimum(self.size[j], self.size[i]) >= self.percent * np.maximum(self.size[j], self.size[i])]
        j = j[(self.low[j] == self.low[i]).sum(1) >= LEAST_BYTES]
        return j[(self.bands[j] == self.bands[i]).argmax(1) == self.band] if len(j) else j


def _links_within(known: DataFrame, facts: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Confirmed links (u, v) between components in each bucket, as few as join them.
    ``known``: band, key, node, root of the members of buckets; ``facts``: node, n_shingles, low, bands."""
    cell = ["band", "key", "y", "x"]

    @tidy
    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            own = _Cell(table, percent)
            has = np.zeros(len(table), bool)
            for i in own.down.tolist():
                j = own.partners(i)
                has[j] = True
                has[i] = len(j) > 0
            yield from table.select([*cell, "node", "root", "outside", "row"]).filter(pa.array(has)).combine_chunks().to_batches()

    @tidy
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            own, links = _Cell(table, percent), []
            packed = table.column("shingles").combine_chunks()
            for i in own.down.tolist():
                mine = np.frombuffer(packed[i].as_buffer(), U)
                for k in own.partners(i).tolist():
                    if own.component[k] != own.component[i]:
                        other = np.frombuffer(packed[k].as_buffer(), U)
                        shared = len(mine) + len(other) - len(np.unique(np.concatenate([mine, other])))
                        if 100 * shared >= percent * (len(mine) + len(other) - shared):
                            own.component[own.component == own.component[k]] = own.component[i]
                            links.append((own.node[i], own.node[k]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["u", "v"])

    sized = known.join(facts.select("node", "n_shingles"), "node")
    roots = sized.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    several = roots.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "root")).alias("great"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    cells = lambda n, size: F.ceil(F.greatest(n / CELL, size / CELL_SHINGLES))
    wide, high = cells(F.col("n"), F.col("size")), cells(F.col("n") - F.col("great.n"), F.col("size") - F.col("great.size"))
    several = several.select("band", "key", F.col("great.root").alias("great"), wide.alias("wide"), high.alias("high"))
    rows = known.join(several, ["band", "key"]).withColumns({"outside": F.expr("root <> great"), "band": F.col("band").cast("long")})
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    names = [*cell, "node", "root", "outside"]
    across = rows.withColumn("x", own("wide")).withColumn("y", F.explode(F.expr("sequence(0L, high - 1)"))).select(*names, F.lit(False).alias("row"))
    down = rows.where("outside").withColumn("y", own("high")).withColumn("x", F.explode(F.expr("sequence(0L, wide - 1)"))).select(*names, F.lit(True).alias("row"))
    dealt = lambda df: df.select(*cell, *(c for c in df.columns if c not in cell)).repartition(*cell).sortWithinPartitions(*cell)
    left = dealt(across.unionByName(down).join(facts, "node")).mapInArrow(survivors, "band bigint, key bigint, y bigint, x bigint, node bigint, root bigint, outside boolean, row boolean")
    left = scratch.write(left, "survivors")
    return dealt(left.join(facts.join(sets, "node"), "node")).mapInArrow(confirmed, "u bigint, v bigint")


def _plausible(percent: int):
    sizes = (100 * F.least("a.n_shingles", "b.n_shingles") >= percent * F.greatest("a.n_shingles", "b.n_shingles"))
    differ = F.bit_count(F.col("a.bits1").bitwiseXOR(F.col("b.bits1"))) + F.bit_count(F.col("a.bits2").bitwiseXOR(F.col("b.bits2")))
    return sizes & (differ <= MOST_BITS)


def near_groups(docs: DataFrame, scratch: Scratch, text: str = "text", ident: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: ``_f``, ``_r``, ``doc_id``, ``n_shingles``, ``component_id`` (the least
    doc_id it is linked to, over any number of links) and ``keeper`` (true for
    one row of each component: the least id, null last, then the first row).

    Rows without words or text are linked with nothing. Null ids are ignored by
    the minimum; a component of null ids only has a null component_id. An empty
    table gives an empty result.
    """
    held = scratch.write(signatures(docs, scratch, text, ident, words), "signatures")
    small = held.where("n_shingles > 0")
    classes = scratch.write(small.groupBy("same").agg(F.min("node").alias("class"), F.count(F.lit(1)).alias("n")), "classes")
    members = scratch.write(join_groups(small.select("node", "same"), classes, "same").select("node", "class"), "members")
    firsts = small.join(members.where("node = class").select("node"), "node", "left_semi")
    firsts = scratch.write(firsts.select("node", "_f", "_r", "n_shingles", "bits1", "bits2", "low", "bands"), "firsts")
    facts = firsts.select("node", "n_shingles", "bits1", "bits2")
    bands = firsts.select("node", F.posexplode("bands").alias("band", "key"))

    hubs = bands.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = scratch.write(bands.join(hubs, ["band", "key"]), "shared")
    stars = shared.groupBy(F.col("node").alias("u")).agg(F.min("hub").alias("v")).where("u <> v")
    stars = stars.join(facts.alias("a"), F.col("u") == F.col("a.node")).join(facts.alias("b"), F.col("v") == F.col("b.node")).where(_plausible(percent)).select("u", "v")
    stars = scratch.write(stars, "stars")
    # Whatever meets another in a bucket may have to be confirmed in either step.
    wanted = firsts.join(shared.select("node").distinct(), "node", "left_semi").select("node", "_f", "_r")
    sets = scratch.write(_full_sets(docs, scratch, scratch.write(wanted, "wanted"), text, words), "sets")
    links = scratch.write(_confirmed(stars, sets, percent), "links")
    roots = components(links, scratch, "first")

    known = shared.select("band", "key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = _links_within(scratch.write(known, "known"), firsts.select("node", "n_shingles", "low", "bands"), sets, scratch, percent)
    roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), scratch, "last")

    owned = members.join(roots.withColumnRenamed("node", "class"), "class", "left").select("node", F.coalesce("root", "class").alias("root"))
    rows = held.select("_f", "_r", "doc_id", "n_shingles", "node").join(owned, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = scratch.write(rows, "rows")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first"), F.count(F.lit(1)).alias("n"))
    least = scratch.write(least.select("root", "component_id", F.col("first.node").alias("first"), "n"), "least")
    out = join_groups(rows, least, "root")
    return out.select("_f", "_r", "doc_id", "n_shingles", "component_id", (F.col("node") == F.col("first")).alias("keeper"))


def drop_near(docs: DataFrame, scratch: Scratch, text: str = "text", ident: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component."""
    dropped = scratch.write(near_groups(docs, scratch, text, ident, words, percent).where("not keeper").select("_f", "_r"), "dropped")
    return without(with_keys(docs, scratch), dropped).select("row.*")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, on shingles of 4 words."""
    rows = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "near"), words=4)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), l AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""
