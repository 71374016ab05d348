"""An order-dependent fold per entity over a stream: streak, stress, personal best, quit alerts.

State is kept by ``transformWithState`` (RocksDB), which passes plain rows: an entity has few in a batch, too few to pay for a
frame of its own. Rows wait in list state until the watermark has passed them
and are then folded in time order, so results don't depend on how rows arrived within the delay. A timer one gap after
the last event ends the session and raises the alert; another drops an entity that has been idle long enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "entity long, event_id long, ts long, streak long, stress double, best double, alert string"
PENDING = "event_id long, ts long, win int, metric double"
STATE = "last_ts long, win_streak long, loss_streak long, stress double, best double, ended boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = Row("entity", "event_id", "ts", "streak", "stress", "best", "alert")
#: Rows put into the state at a time.
CHUNK = 10_000


class QuitRisk(StatefulProcessor):
    """One row per event, and one without an event_id (alert "quit") for each session that ends on a losing run of two
    or more at a stress of ``alert_at`` or more, one gap after its last event."""

    def __init__(self, gap_s: int, idle_s: int, alert_at: float):
        self.gap, self.idle, self.alert_at = gap_s, max(idle_s, gap_s), alert_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.state = handle.getValueState("state", STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = None
        while chunk := [(r.event_id, r.ts, r.win, r.metric) for r in islice(rows, CHUNK)]:
            self.pending.appendList(chunk)
            least = min(r[1] for r in chunk)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(max(first * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() // 1000
        yield from self.fold(key[0], now)

    def fold(self, entity: int, now: int) -> Iterator[Row]:
        # Each call on a state is a message to the JVM; an empty list and an empty value need no call of their own.
        rows = list(self.pending.get())
        ready = sorted((r for r in rows if r[1] <= now), key=lambda r: (r[1], r[0]))
        left = [tuple(r) for r in rows if r[1] > now]
        if ready and left:
            self.pending.put(left)
            self.handle.registerTimer(min(r[1] for r in left) * 1000)
        elif ready:
            self.pending.clear()
        known = self.state.get()
        last, wins, losses, stress, best, ended = known if known else (None, 0, 0, 0.0, None, True)
        for event_id, ts, win, metric in ready:
            if last is not None and ts - last >= self.gap:
                if not ended:
                    yield from self.quit(entity, last, losses, stress, best)
                wins, losses, stress = 0, 0, 0.0
                best = best if ts - last < self.idle else None  # as if it had been dropped, whether or not it was
            seen = metric is not None and metric == metric
            if win == 1:
                wins, losses = wins + 1, 0
                stress = max(0.0, stress - 2.0 * wins)
            else:
                wins, losses = 0, losses + 1
                stress += 1.0 + (0.5 if seen and metric < 45 else 0.0) + (0.5 if seen and metric < 35 else 0.0)
            if seen:
                best = metric if best is None else max(best, metric)
            last, ended = ts, False
            yield RESULT(entity, event_id, ts, wins or -losses, stress, best, "quit risk" if losses >= 2 and stress >= self.alert_at else "")
        if last is not None and not ended and last + self.gap <= now:
            yield from self.quit(entity, last, losses, stress, best)
            ended = True
        if last is None:
            return
        if ended and last + self.idle <= now and not left:
            self.state.clear()
            return
        if not known or (last, ended) != (known[0], known[5]):
            self.state.update((last, wins, losses, stress, best, ended))
            self.handle.registerTimer((last + (self.idle if ended else self.gap)) * 1000)

    def quit(self, entity: int, last: int, losses: int, stress: float, best: float | None) -> list[Row]:
        return [RESULT(entity, None, last + self.gap, -losses, stress, best, "quit")] if losses >= 2 and stress >= self.alert_at else []


def entity_states(events: DataFrame, gap_s: int = 1200, alert_at: float = 3.0, idle_s: int = 30 * 86400, delay: str = "1 day") -> DataFrame:
    """``events`` (entity, event_id, ts, win, metric) folded in time order, appended once the watermark has passed them.

    Rows more than ``delay`` behind the newest of earlier batches are not seen; split them off before. An entity's best
    value and state are forgotten after ``idle_s`` without an event. Entities are spread by hash; what a task holds of
    one is what the delay spans. The session's state store must be RocksDB; it is set where the default stands.
    """
    conf = events.sparkSession.conf
    if conf.get(PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not conf.get(PROVIDER, ""):
        conf.set(PROVIDER, ROCKSDB)
    timed = events.select("entity", "event_id", "ts", "win", "metric", F.timestamp_seconds("ts").alias("event_time")).withWatermark("event_time", delay)
    return timed.groupBy("entity").transformWithState(QuitRisk(gap_s, idle_s, alert_at), OUT, "Append", "EventTime")
