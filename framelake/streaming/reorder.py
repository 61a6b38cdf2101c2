"""A reorder buffer over a stream: samples come about in decode order and leave in presentation order.

A sample can leave when no later one can be presented before it. Composition offsets are not below least_shift, and decode times only rise, so once all
samples up to some index have come, what is still to come is presented at the next decode time plus least_shift or later. State a track: the samples that are held (a list), the next
index and its decode time, and how many have left; a sample is evicted as it leaves, so state is as large as the reordering and not as the track.
Where samples are missing, or the track ends, the held ones leave when the watermark is gap past the track's newest sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "track string, idx bigint, pts bigint, pos bigint"


class ReorderBuffer(StatefulProcessor):
    def __init__(self, least_shift: int, gap_ms: int):
        self.least_shift, self.gap_ms = least_shift, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, as a call of the state is a message to another process
        self.handle = handle
        self.state = handle.getValueState("state", "idx bigint, dts bigint, left bigint, newest bigint, held array<struct<pts:bigint,idx:bigint,dts:bigint,delta:bigint>>")

    def _state(self) -> tuple[int, int, int, int, list[tuple]]:
        state = self.state.get()
        return (*tuple(state)[:4], [tuple(r) for r in state[4]]) if state is not None else (0, 0, 0, 0, [])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        idx, dts, left, newest, held = self._state()
        timer = newest + self.gap_ms if held else None
        for batch in rows:
            newest = max(newest, int(batch["at"].max()))
            held += zip(*[batch[c].tolist() for c in ("pts", "idx", "dts", "delta")], strict=True)
        came = {r[1]: r[2] + r[3] for r in held}
        while idx in came:
            dts = came[idx]
            idx += 1
        held.sort()
        bound = (dts + self.least_shift, idx)  # of what is still to come, at the earliest
        n = next((i for i, r in enumerate(held) if r[:2] >= bound), len(held))
        self._keep(held[n:], idx, dts, left + n, newest, timer)
        if n:
            yield _frame(key[0], held[:n], left)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        idx, dts, left, newest, held = self._state()
        if held:
            held.sort()
            idx, dts = max((idx, dts), *((r[1] + 1, r[2] + r[3]) for r in held))
        self.state.update((idx, dts, left + len(held), newest, []))
        if held:
            yield _frame(key[0], held, left)

    def _keep(self, stay: list[tuple], idx: int, dts: int, left: int, newest: int, timer: int | None) -> None:
        """Keep what stays; a track that holds samples has one timer, gap past its newest sample."""
        self.state.update((idx, dts, left, newest, stay))
        due = newest + self.gap_ms if stay else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def _frame(track: str, rows: list[tuple], left: int) -> pd.DataFrame:
    return pd.DataFrame([(track, r[1], r[0], left + i) for i, r in enumerate(rows)], columns=["track", "idx", "pts", "pos"]).astype({"idx": "int64", "pts": "int64", "pos": "int64"})


def reordered(stream: DataFrame, least_shift: int, gap: str = "1 hour", gap_ms: int = 3_600_000) -> DataFrame:
    """Rows of a stream (track, idx, ts, dts, delta, pts) in presentation order: (track, idx, pts, pos).

    idx counts a track's samples in decode order from 0. ts is the event time: rows that come later than gap behind the newest one count as lost. Rows with a null are left out.
    """
    rows = stream.where("track IS NOT NULL AND idx IS NOT NULL AND ts IS NOT NULL AND pts IS NOT NULL AND dts IS NOT NULL AND delta IS NOT NULL")
    rows = rows.selectExpr("CAST(track AS STRING) AS track", "CAST(ts AS TIMESTAMP) AS ts", "CAST(idx AS BIGINT) AS idx", "CAST(dts AS BIGINT) AS dts", "CAST(delta AS BIGINT) AS delta", "CAST(pts AS BIGINT) AS pts", "unix_millis(CAST(ts AS TIMESTAMP)) AS at")
    return rows.withWatermark("ts", gap).groupBy("track").transformWithStateInPandas(ReorderBuffer(least_shift, gap_ms), OUT, "Append", "EventTime")
