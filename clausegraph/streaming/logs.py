"""Structured Streaming: audit sink, live request limit and follow-up context."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausegraph.operators.limits import MICROS, _admit, _micros
from clausegraph.sources.audit import day_of


def audit_sink(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts"):
    """Exactly-once file sink, one folder per UTC day."""
    return (stream.withColumn("day", day_of(F.to_timestamp(ts))).writeStream.format("json").partitionBy("day")
            .option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))


def live_rate_limit(stream: DataFrame, key: str, ts: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """``(key, at, accepted)`` per event; state per client is at most ``limit`` accepted times."""
    width = seconds * MICROS
    key_type = dict(stream.dtypes)[key]

    def run(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = deque(state.get[0] if state.exists else [])
        times = sorted(at for batch in batches for at in batch["_at"])
        verdicts = [_admit(limit, width, accepted, at) for at in times]
        state.update((list(accepted),))
        yield pd.DataFrame({key: [group[0]] * len(times), "at": times, "accepted": verdicts})

    rows = stream.select(key, _micros(ts).alias("_at"))
    return rows.groupBy(key).applyInPandasWithState(
        run, f"{key} {key_type}, at bigint, accepted boolean", "accepted array<bigint>", "append", GroupStateTimeout.NoTimeout)


def live_followups(stream: DataFrame, conversation: str, turn: str, text: str = "text") -> DataFrame:
    """``(conversation, turn, text, prev_text)`` with the previous question kept as state."""
    types = dict(stream.dtypes)

    def run(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(turn)
        before = [previous, *rows[text].tolist()[:-1]]
        state.update((rows[text].iloc[-1],))
        yield pd.DataFrame({conversation: [group[0]] * len(rows), turn: rows[turn].tolist(), text: rows[text].tolist(),
                            "prev_text": before})

    return stream.select(conversation, turn, text).groupBy(conversation).applyInPandasWithState(
        run, f"{conversation} {types[conversation]}, {turn} {types[turn]}, {text} string, prev_text string", "last string", "append",
        GroupStateTimeout.NoTimeout)


def final_records(deltas: DataFrame) -> DataFrame:
    """Content of streamed answers ``(request_id, seq, delta, final)``: the final record wins over the joined deltas."""
    pieces = F.array_sort(F.collect_list(F.when(F.col("delta").isNotNull(), F.struct("seq", "delta"))))
    joined = F.array_join(F.transform(pieces, lambda p: p.delta), "")
    last = F.max_by("final", F.when(F.col("final").isNotNull(), F.col("seq")))
    return deltas.groupBy("request_id").agg(F.coalesce(last, joined).alias("content"))
