"""Rate limit and cadence over a stream: keyed state that is told in order of time and forgotten after its gap.

Both need Spark's RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). A row is judged
once the watermark has passed its cell of time, so results equal the batch operators' whatever the order
of arrival; rows that come later than the watermark are dropped by Spark, unjudged. Between batches a key
holds the last few instants that passed and its rows that wait for the watermark.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType


#: So many cells of time wait in one value of the state, with one timer for the first of them; those due are judged together.
PAGE = 4096


class _Spaced(StatefulProcessor):
    """Told rows with whether they pass: fewer than ``most`` passed ones lie within the gap before them."""

    def __init__(self, most: int, gap_us: int, grain_ms: int) -> None:
        self.most, self.gap_us, self.grain_ms = most, gap_us, grain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "us array<bigint>")
        self.waiting = handle.getMapState("waiting", "cell bigint", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for part in rows:
            pages: dict[int, list] = {}
            unjudged = []
            for us, row in zip(part["us"], part["row"], strict=True):
                if pd.isna(us):
                    unjudged.append(row)
                else:
                    pages.setdefault(self._cell(int(us)) // PAGE, []).append((int(us), _plain(row)))
            for page, got in pages.items():
                due, held = self._due(got), None
                if self.waiting.containsKey((page,)):
                    held, before = pickle.loads(self.waiting.getValue((page,))[0])
                    got = before + got
                if held is None or due < held:
                    self.handle.registerTimer(due)
                self.waiting.updateValue((page,), (pickle.dumps((due if held is None else min(due, held), got)),))
            if unjudged:
                yield _told(unjudged, [None] * len(unjudged))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        due = int(expiredTimerInfo.getExpiryTimeInMs())
        now = max(due, int(timerValues.getCurrentWatermarkInMs()))
        page = (due // self.grain_ms - 1) // PAGE
        passed = list(self.passed.get()[0]) if self.passed.exists() else []
        rows = pickle.loads(self.waiting.getValue((page,))[0])[1] if self.waiting.containsKey((page,)) else []
        ready = [r for r in rows if (self._cell(r[0]) + 1) * self.grain_ms <= now]
        if not ready:
            if passed and passed[-1] + self.gap_us < due * 1000:
                self.passed.clear()
            return
        if len(ready) < len(rows):
            rest = [r for r in rows if (self._cell(r[0]) + 1) * self.grain_ms > now]
            self.waiting.updateValue((page,), (pickle.dumps((self._due(rest), rest)),))
            self.handle.registerTimer(self._due(rest))
        else:
            self.waiting.removeKey((page,))
        ready.sort(key=lambda r: (r[0], _order(r[1])))
        ok = []
        for us, _ in ready:
            ok.append(len(passed) < self.most or us > passed[-self.most] + self.gap_us)
            if ok[-1]:
                passed = [*passed, us][-self.most :]
        if any(ok):
            self.passed.update((passed,))
            # behind the cell in which the gap ends: whatever is told until then may need what passed
            self.handle.registerTimer((passed[-1] + self.gap_us) // (self.grain_ms * 1000) * self.grain_ms + 2 * self.grain_ms)
        yield _told([r for _, r in ready], ok)

    def _cell(self, us: int) -> int:
        return us // (self.grain_ms * 1000)

    def _due(self, rows: list) -> int:
        """When the first of these rows' cells is over."""
        return (self._cell(min(us for us, _ in rows)) + 1) * self.grain_ms

    def close(self) -> None:
        return


def _plain(row):  # noqa: ANN001, ANN202
    return row.asDict() if hasattr(row, "asDict") else dict(row)


def _order(row: dict) -> tuple:
    """Null before values, as a sort in Spark."""
    return tuple((False,) if v is None else (True, v) for v in row.values())


def _told(rows: list, passes: list) -> pd.DataFrame:
    return pd.DataFrame({"row": [_plain(r) for r in rows], "accepted": pd.array(passes, "boolean")})


def _judged(rows: DataFrame, key: str, at: str, late: str, most: int, gap_us: int, grain_ms: int) -> DataFrame:  # noqa: PLR0913
    if most < 1 or grain_ms < 1:
        raise ValueError("most and grain_ms must be at least one")
    names = [c for c in rows.columns if c != "accepted"]
    timed = rows.select(F.col(key).alias("who"), F.col(at).cast("timestamp").alias("at"), F.struct(*(F.col(c) for c in names)).alias("row")).withColumn("us", F.unix_micros("at")).withWatermark("at", late)
    schema = StructType([timed.schema["row"], StructField("accepted", BooleanType())])
    told = timed.groupBy("who").transformWithStateInPandas(_Spaced(most, gap_us, grain_ms), schema, "Append", "EventTime")
    return told.select(*(F.col("row")[c].alias(c) for c in names), "accepted")


def limited(hits: DataFrame, client: str = "client", at: str = "ts", most: int = 5, window_s: float = 60.0, late: str = "1 minute", grain_ms: int = 1000) -> DataFrame:  # noqa: PLR0913
    """A stream of hits with `accepted`, as ``records.limited`` gives it for a table.

    Null is a client of its own; a hit without a time is neither accepted nor refused: null. Hits at one time
    go by their columns' order, which must be of types that Python orders as Spark does (no NaN, no maps). A column named accepted is replaced.
    """
    return _judged(hits, client, at, late, most, int(window_s * 1e6), grain_ms)


def thinned(positions: DataFrame, seconds: float, late: str = "10 minutes", grain_ms: int = 1000) -> DataFrame:
    """Fixes of a stream at least some seconds after the vessel's last kept one, as ``tracks.thin_by_cadence``; those without a time are left out, those without a vessel are one track."""
    wait = max(int(-(-seconds * 1e6 // 1)), 0)
    return _judged(positions.where("ts is not null"), "mmsi", "ts", late, 1, wait - 1, grain_ms).where("accepted").drop("accepted")
