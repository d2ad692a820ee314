"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by the set of
sources they belong to (the pattern), so the flow problem has a node per pattern
and per source, whatever the number of documents. Token capacity flows from
patterns to source quotas; each further pass over a pattern's documents costs
more (convex repetition costs). The flow of a pattern fixes how many whole
passes all its documents get and how many tokens more; the documents for those
are taken in the order of a seeded hash. Documents that don't fit are passed
over: ``FILLS`` times those that still fit are taken in that order as far as
they go, and then the one that leaves the least gap.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_WORD, Scratch, keyed, with_keys

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
FILLS = 5
#: Patterns (sets of sources that occur) at most, for their sums and the flow are the driver's; more is an error.
MOST_PATTERNS = 1_000_000


def targets(sizes: dict[str | None, int], weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> dict[str | None, float]:
    """The target of each source: ``share`` of all sizes by weight, none above ``most`` times its size.

    Weights repeat over the sources by code point, null last. What a source at
    its limit cannot take is shared again by weight among the others.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    limit = {s: float(most * sizes[s]) for s in order}
    free, rest = set(order), share * sum(sizes.values())
    level = 0.0
    while free:
        level = max(0.0, rest) / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > limit[s]}
        if not full:
            break
        free -= full
        rest -= sum(limit[s] for s in full)
    return {s: weight[s] * level if s in free else limit[s] for s in order}


class _Flow:
    """Successive shortest paths on a small graph."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        while True:
            far, by, queue, queued = {source: 0}, {}, deque([source]), {source}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.out[a]:
                    if self.left[e] and far[a] + self.cost[e] < far.get(self.to[e], math.inf):
                        far[self.to[e]], by[self.to[e]] = far[a] + self.cost[e], e
                        if self.to[e] not in queued:
                            queue.append(self.to[e])
                            queued.add(self.to[e])
            if sink not in far:
                return
            path, at = [], sink
            while at != source:
                path.append(by[at])
                at = self.to[by[at] ^ 1]
            amount = min(self.left[e] for e in path)
            for e in path:
                self.left[e] -= amount
                self.left[e ^ 1] += amount


def route(patterns: dict[tuple, int], quotas: dict[str | None, float], most: int = MOST) -> dict[tuple, dict[str | None, int]]:
    """Tokens that each pattern gives each of its sources: the most that the
    quotas take, with the least repetition. Patterns that share no source, even
    through others, are separate problems."""
    group: dict = {}

    def root(x):
        while group.setdefault(x, x) != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for p in patterns:
        for s in p[1:]:
            group[root(s)] = root(p[0])
    problems = defaultdict(list)
    for p in patterns:
        problems[root(p[0])].append(p)
    out: dict[tuple, dict[str | None, int]] = {}
    for own in problems.values():
        flow, sources = _Flow(), sorted({s for p in own for s in p}, key=lambda s: (s is None, s or ""))
        node = {s: 2 + k for k, s in enumerate(sources)}
        for s in sources:
            flow.arc(node[s], 1, round(quotas[s]), 0)
        arcs = {}
        for k, p in enumerate(own):
            at = 2 + len(sources) + k
            for again in range(most):  # convex: the k-th pass costs k a token
                flow.arc(0, at, patterns[p], again)
            for s in p:
                arcs[p, s] = flow.arc(at, node[s], most * patterns[p], 0)
        flow.run(0, 1)
        for p in own:
            out[p] = {s: flow.left[arcs[p, s] ^ 1] for s in p}
    return out


def _pattern(membership: Column) -> Column:
    """The sources of a row as a key: sorted, each once."""
    return F.to_json(F.array_sort(F.array_distinct(membership)))


def _place(ident: Column, seed: str) -> Column:
    """Where a row stands in the seeded order; ties go by id, then key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))


#: A row's place in its pattern's order, and whether a fill has taken it.
ORDER = "struct(place, doc_id, _f, _r)"
FILLED = f"size > 0 and exists(cuts, c -> size <= c.gap and {ORDER} <= c.bound)"


def _fill(sized: DataFrame, state: DataFrame) -> DataFrame:
    """Takes rows that fit in their pattern's gap, in order, as far as they go.

    ``state``: pattern, gap and cuts (gap and bound of the fills before). Sums over hash ranges find the
    range where a gap runs out; only that range is sorted. Returns pattern, ``used`` and ``bound``."""
    fitting = sized.join(state, "pattern").where(f"size > 0 and size <= gap and not ({FILLED})")
    ranges = fitting.groupBy("pattern", "range").agg(F.sum("size").alias("range_size"), F.max(F.expr(ORDER)).alias("top"), F.first("gap").alias("gap"))
    before = F.coalesce(F.sum("range_size").over(Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("before", before)
    whole = ranges.where("before + range_size <= gap").select("pattern", F.col("range_size").alias("used"), F.col("top").alias("bound"))
    edge = fitting.drop("gap").join(ranges.where("before <= gap and before + range_size > gap").select("pattern", "range", "before", "gap"), ["pattern", "range"])
    up_to = F.col("before") + F.sum("size").over(Window.partitionBy("pattern").orderBy("place", "doc_id", "_f", "_r").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("up_to", up_to).where("up_to <= gap").select("pattern", F.col("size").alias("used"), F.expr(ORDER).alias("bound"))
    return whole.unionByName(edge).groupBy("pattern").agg(F.sum("used").alias("used"), F.max("bound").alias("bound"))


def plan_mix(
    docs: DataFrame, scratch: Scratch, membership: Column, text: str, ident: str, weights: Sequence[int], share: float, most: int, seed: str
) -> tuple[DataFrame, DataFrame]:
    """The sized rows, and a row per pattern that fixes what is taken: ``passes`` over all its
    documents, once more for those that a fill took (``cuts``) and for ``extra``."""
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    sized = keyed(docs, scratch, {"doc_id": F.col(f"`{ident}`").cast("long"), "sources": F.array_sort(F.array_distinct(membership)), "size": words})
    sized = scratch.write(sized.withColumns({"pattern": _pattern(F.col("sources")), "place": _place(F.col("doc_id"), seed)}), "sized")
    rows = sized.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources")
    patterns = {tuple(r.sources): r["size"] for r in rows}
    names = {tuple(r.sources): r.pattern for r in rows}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    # A document of several sources counts once in the share, and in each source's size.
    quotas = targets(sizes, weights, share * sum(patterns.values()) / max(1, sum(sizes.values())), most)
    routed = route(patterns, quotas, most)
    plan = []
    for p, n in patterns.items():
        flow = sum(routed[p].values())
        passes = flow // n if n else 0
        plan.append((names[p], passes, flow - passes * n, float(sum(quotas[s] for s in p)), sum(sizes[s] for s in p)))
    plan = spark.createDataFrame(plan, "pattern string, passes bigint, gap bigint, target double, source_size bigint")

    digits = 3 + max(0, math.ceil(math.log(max(1, sum(r.n for r in rows)) / 4e8, 16)))
    few = len(rows) <= 10_000  # rows of that many patterns at most are broadcast
    sent = lambda df: F.broadcast(df) if few else df
    ranged = sized.withColumn("range", F.substring("place", 1, digits))
    none = F.expr("cast(array() as array<struct<gap: bigint, bound: struct<place: string, doc_id: bigint, _f: bigint, _r: bigint>>>)")
    state = scratch.write(plan.withColumn("cuts", none), "cuts-0")
    for k in range(FILLS):
        found = _fill(ranged, sent(state.select("pattern", "gap", "cuts")))
        cuts = F.when(F.col("bound").isNull(), F.col("cuts")).otherwise(F.concat("cuts", F.array(F.struct("gap", "bound"))))
        state = state.join(sent(found), "pattern", "left").withColumn("cuts", cuts).withColumn("gap", F.col("gap") - F.coalesce("used", F.lit(0)))
        state = scratch.write(state.drop("used", "bound"), f"cuts-{k + 1}")

    # Of the others, the document that best fills what is then left is taken too.
    others = sized.join(sent(state.select("pattern", "gap", "cuts")), "pattern").where(f"size > 0 and abs(size - gap) < gap and not ({FILLED})")
    best = others.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.expr(ORDER).alias("at"))).alias("best")).select("pattern", F.col("best.at").alias("extra"))
    cutoffs = scratch.write(state.join(best, "pattern", "left").select("pattern", "passes", "cuts", "extra", "target", "source_size"), "cutoffs")
    return sized, sent(cutoffs)


#: How often a row is taken, where its pattern's cutoffs are joined to it.
TIMES = f"if(size = 0, 0L, passes + cast(coalesce({FILLED}, false) or coalesce({ORDER} = extra, false) as bigint))"


def mix(
    docs: DataFrame,
    scratch: Scratch,
    membership: Column,
    text: str = "text",
    ident: str = "doc_id",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """For each row: ``_f``, ``_r``, ``doc_id``, ``sources``, ``size`` and ``taken`` (tokens, repeats counted).

    ``membership`` is the array of sources of a row (null is a source of its
    own). Sizes are words between white space; a null text has none. Whole
    documents are taken, 0 to ``most`` times each; a pattern's total is off its
    flow by what the fills and the best single document leave. Only sums by pattern
    (the sets of sources that occur, ``MOST_PATTERNS`` at most) come to the driver.
    Rows of the same id count apart. An empty table gives an empty result.
    """
    sized, cutoffs = plan_mix(docs, scratch, membership, text, ident, weights, share, most, seed)
    rows = sized.join(cutoffs, "pattern").withColumn("times", F.expr(TIMES))
    return rows.select("_f", "_r", "doc_id", "sources", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def repeat_documents(docs: DataFrame, scratch: Scratch, text: str = "text", ident: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it. The cutoffs decide each row where it is read."""
    member = lambda c: F.array(c.cast("string"))
    _, cutoffs = plan_mix(docs, scratch, member(F.col(f"`{source}`")), text, ident, WEIGHTS, SHARE, MOST, SEED)
    own = {"pattern": _pattern(member(F.col(f"row.`{source}`"))), "doc_id": F.col(f"row.`{ident}`").cast("long")}
    own["size"] = F.coalesce(F.regexp_count(F.col(f"row.`{text}`").cast("string"), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    rows = with_keys(docs, scratch).withColumns(own)
    rows = rows.withColumn("place", _place(F.col("doc_id"), SEED)).join(cutoffs, "pattern").withColumn("times", F.expr(TIMES)).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, Scratch(spark, "mix"), F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


#: One fill: what fits in the gap of its source is taken in order as far as it goes.
_FILL_SQL = """, e{k} AS (
  SELECT *, NOT taken AND size > 0 AND size <= gap AS fits FROM f{j}
), n{k} AS (
  SELECT * EXCLUDE (fits), fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) <= gap AS hit FROM e{k}
), f{k} AS (
  SELECT * EXCLUDE (gap, taken, hit), gap - sum(CASE WHEN hit THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap, taken OR hit AS taken FROM n{k}
)"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0 * source_size / w AS ratio, 1.5 * sum(source_size) OVER () AS share FROM s
), c AS (
  SELECT *, CAST((share - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS DOUBLE)
    / sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), l AS (
  SELECT level FROM c WHERE level <= ratio ORDER BY ratio, source LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN w * l.level > 2.0 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE w * l.level END AS target FROM c, l
), p AS (
  SELECT *, CAST(CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(round_even(target, 0) AS BIGINT), 2 * source_size) // source_size END AS BIGINT) AS passes,
    CAST(CASE WHEN source_size = 0 THEN 0 ELSE least(CAST(round_even(target, 0) AS BIGINT), 2 * source_size) % source_size END AS BIGINT) AS rest FROM t
), f0 AS (
  SELECT d.*, p.source_size, p.target, p.passes, p.rest AS gap, false AS taken FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)"""
OP7_SQL += "".join(_FILL_SQL.format(j=k, k=k + 1) for k in range(FILLS))
OP7_SQL += f""", b AS (
  SELECT *, row_number() OVER (PARTITION BY source, taken OR size = 0 OR abs(size - gap) >= gap ORDER BY abs(size - gap), place, doc_id) = 1
    AND NOT taken AND size > 0 AND abs(size - gap) < gap AS extra FROM f{FILLS}
)
SELECT doc_id, size, source_size, target, size * (passes + CASE WHEN taken OR extra THEN 1 ELSE 0 END) AS taken FROM b
"""
