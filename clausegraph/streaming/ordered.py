"""Stateful streams in the order of event time: waiting events, timers, expiry, late rows.

Events of a key wait in its state until the watermark has passed them; a timer then hands them over in the order of
``(time, event id)``, whatever order they arrived in.  Rows behind the watermark are late and Spark drops them, for the
decisions around them are made.  A key without waiting events loses its state when its carried value has expired.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausegraph.operators.limits import MICROS, _admit, _micros

Fold = Callable[[object, int, dict], tuple[object, object]]


def in_event_order(stream: DataFrame, key: str, ts: str, event: str, payload: list[str], result: str, fold: Fold, keep_seconds: int,
                   delay: str = "1 minute") -> DataFrame:
    """``(key, event, at, result)``, one row per event of ``stream`` that is not late; ``at`` is in microseconds.

    ``fold(carried, at, row)`` gets what the events before left (None at first) and the ``payload`` of one event, and gives what
    it leaves, as plain values, and the ``result`` (a SQL type) of the event.  A key's
    carried value is forgotten ``keep_seconds`` after its last event.  Batches are read one at a time; what a key holds is its
    events within ``delay`` of the latest.
    """
    types = dict(stream.dtypes)
    text = F.to_json(F.struct(*payload)) if payload else F.lit("{}")
    rows = stream.withWatermark(ts, delay).select(
        key, F.col(ts).alias("_ts"), _micros(ts).alias("_at"), F.col(event).cast("string").alias("_event"), text.alias("_row"))

    def run(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carried, last, waiting = (json.loads(state.get[0]), state.get[1], json.loads(state.get[2])) if state.exists else (None, None, [])
        passed = state.getCurrentWatermarkMs() * 1000  # 0 before the first watermark
        if not state.hasTimedOut:
            for batch in batches:
                for at, name, row in zip(batch["_at"].tolist(), batch["_event"].tolist(), batch["_row"].tolist(), strict=True):
                    (late if at < passed else waiting).append((at, name) if at < passed else [at, name, row])
        waiting.sort(key=lambda w: (w[0], len(w[1] or ""), w[1] or ""))
        out: list[tuple] = []
        due = 0
        while due < len(waiting) and waiting[due][0] < passed:
            at, name, row = waiting[due]
            if last is not None and at - last >= keep_seconds * MICROS:
                carried = None
            carried, verdict = fold(carried, at, json.loads(row))
            last = at
            out.append((name, at, verdict))
            due += 1
        waiting = waiting[due:]
        if waiting or (last is not None and last + keep_seconds * MICROS >= passed):
            state.update((json.dumps(carried), last, json.dumps(waiting)))
            next_time = waiting[0][0] if waiting else last + keep_seconds * MICROS
            state.setTimeoutTimestamp(max(next_time, passed) // 1000 + 1)
        elif state.exists:
            state.remove()
        names, times, verdicts = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        yield pd.DataFrame({key: pd.Series([group[0]] * len(out), dtype=object), "event": pd.Series(names, dtype=object), "at": pd.Series(times, dtype="int64"),
                            "result": pd.Series(verdicts, dtype=object)})

    return rows.groupBy(key).applyInPandasWithState(
        run, f"{key} {types[key]}, event string, at bigint, result {result}", "carried string, last bigint, waiting string", "append",
        GroupStateTimeout.EventTimeTimeout)


def rate_limit_in_order(stream: DataFrame, key: str, ts: str, event: str, limit: int = 60, seconds: int = 60, delay: str = "1 minute") -> DataFrame:
    """``(key, event, at, accepted)``: the sliding limit over events in the order of their times.

    The same verdicts as ``operators.limits.rate_limit`` for all events that are not late.
    """
    width = seconds * MICROS

    def fold(carried, at: int, row: dict):
        accepted = deque(carried or [])
        verdict = _admit(limit, width, accepted, at)
        return list(accepted), verdict

    return in_event_order(stream, key, ts, event, [], "boolean", fold, seconds, delay).withColumnRenamed("result", "accepted")


def followups_in_order(stream: DataFrame, conversation: str, ts: str, turn: str, text: str = "text", keep_seconds: int = 86_400, delay: str = "1 minute") -> DataFrame:
    """``(conversation, event, at, prev_text)``: the question before each turn, in the order of their times."""
    def fold(carried, at: int, row: dict):
        return row.get(text), carried

    return in_event_order(stream, conversation, ts, turn, [text], "string", fold, keep_seconds, delay).withColumnRenamed("result", "prev_text")
