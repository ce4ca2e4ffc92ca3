"""Scopes as keyed streaming state: idle and absolute deadlines, and the admission limits, one state for each scope."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.vocabulary import LIMITS

STATE = "created long, last long, turns long, files long, bytes long, pages long"
OUTPUT = "scope_id string, status string, turn_count long, file_count long, cumulative_bytes long, cumulative_pages long, refused long"


def scope_stream(turns: DataFrame, idle_ms: int, absolute_ms: int, limits: dict[str, int] = LIMITS, delay: str = "10 minutes") -> DataFrame:
    """turns (scope_id string, at timestamp, files long, bytes long, pages long) as a stream -> a row for each scope and batch: ACTIVE
    or, at its deadline, EXPIRED. A turn at or after the deadline opens the scope anew; a refused one adds nothing."""
    most = [limits[k] for k in ("turns", "files", "bytes", "pages")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda status, sums, refused: pd.DataFrame([(key[0], status, *sums, refused)], columns=[x.split()[0] for x in OUTPUT.split(", ")])
        if state.hasTimedOut:
            _, _, *sums = state.get
            state.remove()
            yield row("EXPIRED", sums, 0)
            return
        created, last, *sums = state.get if state.exists else (None, None, 0, 0, 0, 0)
        refused, ended = 0, []
        rows = [(int(at.timestamp() * 1000), *(int(x) for x in more)) for batch in batches for at, *more in batch[["at", "files", "bytes", "pages"]].itertuples(index=False)]
        for at, *more in sorted(rows):  # a micro-batch's turns of one scope
            if created is not None and at >= min(last + idle_ms, created + absolute_ms):
                ended.append(row("EXPIRED", sums, 0))
                created, sums = None, [0, 0, 0, 0]
            created = at if created is None else created
            last = at
            then = [a + b for a, b in zip(sums, (1, *more), strict=True)]
            if any(x > limit for x, limit in zip(then, most, strict=True)):
                refused += 1
            else:
                sums = then
        state.update((created, last, *sums))
        state.setTimeoutTimestamp(max(min(last + idle_ms, created + absolute_ms), state.getCurrentWatermarkMs() + 1))
        yield from ended
        yield row("ACTIVE", sums, refused)

    return turns.withWatermark("at", delay).groupBy("scope_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
