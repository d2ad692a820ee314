"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives every vector a long string of hash bits; the strings of a shard
are kept as a sorted array per tree. A query first descends: a binary search in
every array finds the longest prefix that any vector shares with it. Then it
ascends in all trees at once, one bit at a time, and every vector that shares
the shorter prefix in some tree becomes a candidate, until there are enough.
Candidates are compared by exact distance on the original vectors.

A bit is the sign of a projection; directions and thresholds are fitted on a
bounded sample, so that they follow the spread of the data. Every row is indexed.
How many candidates are enough is fitted there too: the least share of the rows
that finds the sample's own nearest, so that data with structure need few.
Rows are dealt to shards by their keys. Shards are independent: the queries pass
every shard, whose arrays are built once, as a stream behind its rows, and the
best of all shards are a query's result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, keyed, tidy

K = 10
TREES = 16
BITS = 32
#: Rows on which directions and the share are fitted, at most, and queries among them.
SAMPLE = 4096
TRIALS = 200
#: Rows of a shard, about.
SHARD = 1 << 14
#: A query ascends until its trees together have offered the fitted share of a shard's rows (repeats counted):
#: the first of these at which the sample's queries find this part of their nearest.
SHARES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.4, 2.0, 3.0, 4.5, 7.0, 11.0, 16.0)
RECALL = 0.99
#: Different lengths of vectors, at most; each has an index of its own.
MOST_LENGTHS = 64
SEED = 7


@dataclass
class Forest:
    """The hash functions of all trees."""

    directions: np.ndarray  # dimension x (trees * bits)
    thresholds: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> Forest:
        random = np.random.Generator(np.random.PCG64(seed))
        centre = sample.mean(0)
        spread, axes = np.linalg.eigh(np.cov((sample - centre).T) if len(sample) > 1 else np.eye(sample.shape[1]))
        weights = random.standard_normal((sample.shape[1], trees * bits)) * np.sqrt(np.maximum(spread, 1e-12))[:, None]
        directions = axes @ weights
        return cls(directions, np.median(sample @ directions, axis=0))

    def strings(self, vectors: np.ndarray, tree: int, bits: int = BITS) -> np.ndarray:
        at = slice(tree * bits, (tree + 1) * bits)
        signs = vectors @ self.directions[:, at] > self.thresholds[at]
        return signs @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))

    @property
    def trees(self) -> int:
        return self.directions.shape[1] // BITS


class Shard:
    """The sorted arrays of some rows."""

    def __init__(self, forest: Forest, vectors: np.ndarray) -> None:
        self.forest, self.vectors = forest, vectors
        strings = [forest.strings(vectors, t) for t in range(forest.trees)]
        self.orders = [np.argsort(s, kind="stable") for s in strings]
        self.sorted = [s[o] for s, o in zip(strings, self.orders)]

    def candidates(self, queries: np.ndarray, share: float) -> Iterator[np.ndarray]:
        """For each query, the rows that it meets on the way up to the level where ``share`` times the shard's are offered."""
        strings = [self.forest.strings(queries, t) for t in range(self.forest.trees)]
        low = np.zeros((BITS + 1, len(strings), len(queries)), np.int64)
        high = np.zeros_like(low)
        for level in range(BITS + 1):  # bits that are ignored: all rows share the empty prefix
            for t, s in enumerate(strings):
                prefix = s >> np.uint64(level)
                low[level, t] = np.searchsorted(self.sorted[t], prefix << np.uint64(level), "left")
                high[level, t] = np.searchsorted(self.sorted[t], ((prefix + np.uint64(1)) << np.uint64(level)) - np.uint64(1), "right")
        offered = (high - low).sum(1)
        level = np.argmax(offered >= min(share, len(strings)) * len(self.vectors), axis=0)
        for q, x in enumerate(level.tolist()):
            met = np.zeros(len(self.vectors), bool)
            for t, order in enumerate(self.orders):
                met[order[low[x, t, q] : high[x, t, q]]] = True
            yield np.flatnonzero(met)


def usable(vector: Column) -> Column:
    """Not null or zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def best_of(points: np.ndarray, query: np.ndarray, met: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of the rows ``met``, ties by ``order``, and their distances."""
    far = np.sqrt(((points[met] - query) ** 2).sum(1))
    if len(far) > k:
        near = far <= np.partition(far, k - 1)[k - 1]
        met, far = met[near], far[near]
    best = np.lexsort((order[met], far))[:k]
    return met[best], far[best]


def fitted_share(forest: Forest, sample: np.ndarray, k: int = K) -> float:
    """The least share at which the sample's rows find RECALL of their nearest in it."""
    shard, every = Shard(forest, sample), np.arange(len(sample))
    queries = every[:: max(1, len(sample) // TRIALS)]
    true = [set(best_of(sample, sample[q], every[every != q], every, k)[0].tolist()) for q in queries.tolist()]
    total = sum(map(len, true))
    for share in SHARES:
        hit = sum(len(t.intersection(met.tolist())) for t, met in zip(true, shard.candidates(sample[queries], share)))
        if hit >= RECALL * total:
            return share
    return SHARES[-1]


def nearest(
    vectors: DataFrame,
    scratch: Scratch,
    is_query: Column,
    k: int = K,
    column: str = "embedding",
    ident: str = "vec_id",
) -> DataFrame:
    """The ``k`` nearest found of each row where ``is_query``, among all other rows:
    query_id, rank, vec_id, score (Euclidean distance in double precision), and
    ``compared`` (rows of its shard that a query met there, of which this is one).

    ``is_query`` is an expression on ``vec_id``. Vectors that aren't usable take
    no part, and vectors meet only those of the same length. A row is never its
    own neighbour, but a repeat of it is. Ties go to the smaller vec_id, null
    last. An empty table gives an empty result. The result depends on the rows
    and their files, not on how they are read.
    """
    spark = vectors.sparkSession
    rows = keyed(vectors, scratch, {"vec_id": F.col(f"`{ident}`").cast("long"), "v": F.col(f"`{column}`").cast("array<double>")}).where(usable(F.col("v")))
    counts = {r["size"]: r["n"] for r in rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LENGTHS + 1).collect()}
    if len(counts) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    if not counts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, compared bigint")
    forests: dict[int, tuple[Forest, float]] = {}
    for size in counts:
        table = rows.where(F.size("v") == size).select("v").orderBy(F.xxhash64("_r", "_f"), "_f", "_r").limit(SAMPLE).toArrow()
        sample = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        forest = Forest.fit(sample)
        forests[size] = forest, fitted_share(forest, sample, k)
    held = spark.sparkContext.broadcast(forests)
    shards = {size: -(-n // SHARD) for size, n in counts.items()}

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for batch in batches:  # the rows of each shard, then the queries
            place = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                size, number, kind = place[a].tolist()
                if (size, number) != at:
                    at, parts, shard = (size, number), [], None
                part = batch.slice(a, b - a)
                if kind == 0:
                    parts.append(part)
                    continue
                forest, share = held.value[size]
                if shard is None and parts:
                    points = pa.Table.from_batches(parts)
                    f, r = (points.column(c).to_numpy() for c in ("_f", "_r"))
                    ids = points.column("vec_id").combine_chunks()
                    order = ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
                    flat = points.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                    shard, parts = Shard(forest, flat), []
                if shard is None:
                    continue
                asked = part.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                keys = np.stack([part.column(c).to_numpy() for c in (3, 4)], 1)
                out: list[tuple[np.ndarray, ...]] = []
                for first in range(0, len(asked), 256):
                    for q, met in enumerate(shard.candidates(asked[first : first + 256], share), first):
                        met = met[(f[met] != keys[q, 0]) | (r[met] != keys[q, 1])]
                        if len(met):
                            best, far = best_of(flat, asked[q], met, order, k)
                            out.append((np.full(len(best), q), best, far, np.full(len(best), len(met))))
                if out:
                    q, met, far, compared = (np.concatenate(x) for x in zip(*out))
                    own = [pa.array(keys[q, 0]), pa.array(keys[q, 1]), part.column(5).take(pa.array(q)), ids.take(pa.array(met)), pa.array(far), pa.array(compared)]
                    yield pa.RecordBatch.from_arrays(own, names=["_f", "_r", "query_id", "vec_id", "score", "compared"])

    rows = scratch.write(rows.select(F.size("v").cast("long").alias("size"), "_f", "_r", "vec_id", "v"), "rows")
    number = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in shards.items() for x in kv]), F.col("size"))
    own = ["_f", "_r", "vec_id", "v"]
    dealt = rows.select("size", F.pmod(F.xxhash64("_r", "_f"), number).alias("shard"), F.lit(0).cast("long").alias("kind"), *own)
    asked = rows.where(is_query).select("size", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("shard"), F.lit(1).cast("long").alias("kind"), *own)
    both = dealt.unionByName(asked).repartition(sum(shards.values()), "size", "shard").sortWithinPartitions("size", "shard", "kind")
    found = both.mapInArrow(work, "_f bigint, _r bigint, query_id bigint, vec_id bigint, score double, compared bigint")
    ranked = Window.partitionBy("_f", "_r").orderBy("score", F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100."""
    found = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "ann"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")
