"""Overlay rows kept as stream state that expires by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.operators.overlays import COUNT, TTL_SECONDS

OUTPUT = "kind string, key bigint, value string, deadline timestamp, alive boolean"
STATE = "value string, deadline bigint"


def _update(ttl_ms: int):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, number = key
        value, deadline = state.get if state.exists else (None, 0)
        expired = state.hasTimedOut
        if not expired:
            for rows in batches:
                for row in rows.sort_values("at").itertuples():
                    at = int(row.at.value // 1_000_000)
                    fresh = at < deadline
                    if kind == COUNT and fresh:
                        value = str(int(value or 0) + int(row.value))
                    elif at + ttl_ms >= deadline:
                        # The deadline tells when the value was set; a late, older row does not replace it.
                        value = row.value
                    deadline = max(deadline, at + ttl_ms)
            if deadline <= state.getCurrentWatermarkMs():
                expired = True
        if expired:
            state.remove()
        else:
            state.update((value, deadline))
            state.setTimeoutTimestamp(deadline)
        yield pd.DataFrame({
            "kind": [kind], "key": [number], "value": [value],
            "deadline": [pd.Timestamp(deadline, unit="ms")], "alive": [not expired],
        })

    return update


def live_overlays(events: DataFrame, delay: str = "0 seconds", ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """State changes of ``kind, key, value, at``: a row when an overlay is set and one when it ends.

    The watermark is the clock: an overlay ends once events have moved past its deadline.
    """
    return (
        events.withWatermark("at", delay)
        .groupBy("kind", "key")
        .applyInPandasWithState(
            _update(ttl_seconds * 1000), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
    )
