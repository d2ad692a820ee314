"""Relational operators on the append log: a row per save, ``seq`` rising with each.

The current state of a key is its row of the greatest ``seq``; of an event id
the first row counts. Both fold with partial aggregation before the one shuffle
on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING = ("pending", "failed", "unknown")
TOP = 12


def latest(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last row of each key; ``seq`` stays, for it is the order of saving."""
    rest = [c for c in log.columns if c not in (key, seq)]
    folded = log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("last"), F.max(seq).alias(seq))
    return folded.select(key, seq, "last.*")


def first(log: DataFrame, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """The first row of each key: a repeated event is ignored."""
    rest = [c for c in log.columns if c not in (*key, seq)]
    folded = log.groupBy(*key).agg(F.min_by(F.struct(*rest), seq).alias("first"), F.min(seq).alias(seq))
    return folded.select(*key, seq, "first.*")


def lookup(meta: DataFrame, asked: DataFrame, default: str) -> DataFrame:
    """The value of each asked key, or the default where it was never set."""
    return asked.join(meta, "key", "left").select("key", F.coalesce("value", F.lit(default)).alias("value"))


def missing(asked: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Asked ids without a row."""
    return asked.join(state, key, "left_anti").withColumn("error", F.lit("missing_begin"))


def first_pending(state: DataFrame, key: str, status: str, seq: str = "seq", pending: Sequence[str] = PENDING) -> DataFrame:
    """The refusal of a new task while one awaits publication: the one saved longest ago."""
    waiting = state.where(F.col(status).isin(*pending))
    named = waiting.agg(F.min_by(F.col(key), seq).alias("id"))
    return named.where("id is not null").select(F.concat(F.lit("pending_task_retry_push:"), F.col("id").cast("string")).alias("error"))


def any_active(state: DataFrame, active: Column) -> DataFrame:
    """One row: whether any task is active."""
    return state.agg(F.coalesce(F.bool_or(active), F.lit(False)).alias("active"))


def most_recent(state: DataFrame, *order: Column, n: int = TOP) -> DataFrame:
    """The first ``n`` rows of an order: a top-k in each task, then one of those."""
    return state.orderBy(*order).limit(n)


def begin(requests: DataFrame, state: DataFrame, key: str, stored: Sequence[str]) -> DataFrame:
    """A task that exists is answered as it is stored, whatever the request says."""
    known = state.select(key, *[F.col(c).alias(f"old_{c}") for c in stored], F.lit(True).alias("known"))
    joined = requests.join(known, key, "left").withColumn("existing", F.coalesce("known", F.lit(False)))
    return joined.select(key, "existing", *[F.when(F.col("existing"), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in stored])


def decoded(log: DataFrame, schema: str) -> DataFrame:
    """The log with its JSON ``body`` as a typed struct ``task``; nulls in maps stay, keys not yet set are null."""
    return log.withColumn("task", F.from_json("body", schema)).drop("body")
