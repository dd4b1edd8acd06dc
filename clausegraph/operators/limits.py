"""Sliding-window request limits over event logs, exact and without one task per client."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.operators.scale import bucketed_lag

MICROS = 1_000_000


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing_count(events: DataFrame, key: str, ts: str, seconds: int, name: str = "n_trailing", spans: int = 16) -> DataFrame:
    """Events of the key in the inclusive trailing window, each event counted with itself.

    Time is cut into buckets of ``spans`` windows; the last window of a bucket is
    repeated in the next one as context.  A client with a third of all events is
    thus spread over many tasks.
    """
    width = seconds * MICROS
    at = _micros(ts)
    rows = events.withColumn("_at", at).withColumn("_b", F.floor(F.col("_at") / (width * spans)))
    late = F.col("_at") >= (F.col("_b") + 1) * (width * spans) - width
    copies = F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("c")),
                     F.when(late, F.struct((F.col("_b") + 1).alias("b"), F.lit(True).alias("c"))))
    placed = rows.withColumn("_p", F.explode(F.filter(copies, lambda p: p.isNotNull())))
    window = Window.partitionBy(key, "_p.b").orderBy("_at").rangeBetween(-width, 0)
    counted = placed.withColumn(name, F.count(F.lit(1)).over(window))
    return counted.where(~F.col("_p.c")).drop("_at", "_b", "_p")


def with_sessions(events: DataFrame, key: str, ts: str, seconds: int, spans: int = 64) -> DataFrame:
    """Adds ``session``: start of the run of events without a pause of ``seconds``.

    After such a pause nothing of the past counts any more, so sessions of one
    client are independent units of work.
    """
    width = seconds * MICROS
    rows = events.withColumn("_at", _micros(ts))
    rows = bucketed_lag(rows, key, F.col("_at"), ["_at"], F.floor(F.col("_at") / (width * spans)))
    fresh = F.col("prev__at").isNull() | (F.col("_at") - F.col("prev__at") >= width)
    rows = rows.withColumn("_start", F.when(fresh, F.col("_at"))).withColumn("_b", F.floor(F.col("_at") / (width * spans)))
    inside = Window.partitionBy(key, "_b").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.max("_start").over(inside))
    tails = rows.groupBy(key, "_b").agg(F.max("_start").alias("_t"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.withColumn("_carry", F.max("_t").over(before)).drop("_t")
    out = rows.join(carry, [key, "_b"], "left").withColumn("session", F.coalesce("_run", "_carry"))
    return out.drop("_b", "_start", "_run", "_carry", "_at", "prev__at")


def _admit(limit: int, width: int, accepted: deque, at: int) -> bool:
    """Forget accepted events that left the window, then admit while there is room."""
    while accepted and at - accepted[0] >= width:
        accepted.popleft()
    if len(accepted) >= limit:
        return False
    accepted.append(at)
    return True


def rate_limit(events: DataFrame, key: str, ts: str, order: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """``(key, order, ts, accepted)``: exact sliding log where rejected events are not recorded.

    Sessions with at most ``limit`` events are admitted without leaving the JVM.
    The rest is sorted inside partitions and streamed through a helper that holds
    at most ``limit`` times of the running session, never a whole group.
    """
    width = seconds * MICROS
    rows = with_sessions(events.select(key, order, ts), key, ts, seconds)
    sizes = rows.groupBy(key, "session").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(sizes, [key, "session"])
    calm = rows.where(F.col("_n") <= limit).select(key, order, ts, F.lit(True).alias("accepted"))
    busy = rows.where(F.col("_n") > limit).select(key, order, ts, "session", _micros(ts).alias("_at"))
    busy = busy.repartition(key, "session").sortWithinPartitions(key, "session", "_at", order)
    types = dict(events.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, {ts} {types[ts]}, accepted boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for batch in batches:
            verdicts = []
            for k, s, at in zip(batch[key], batch["session"], batch["_at"]):
                if (k, s) != current:
                    current, accepted = (k, s), deque()
                verdicts.append(_admit(limit, width, accepted, at))
            yield batch[[key, order, ts]].assign(accepted=verdicts)

    return calm.unionByName(busy.mapInPandas(run, schema))
