"""Rows that wait in a stream's state: until there are enough, in chunks of one size, or for their turn.

State lives in the stream's checkpoint (list, map and value state, one set for each key), so a query that is killed
goes on with what it held: no row is lost or comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Needed before a query of this module starts: the state store with lists and maps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


#: Rows sent to the state at once.
CHUNK = 1024


class Held(StatefulProcessor):
    """Rows of a key leave together when the weights among them reach ``least``, or ``patience`` ms after the last came.

    With ``size`` rows leave in chunks of that many; what is left over waits, or leaves when patience ends.
    """

    def __init__(self, columns: str, names: list[str], least: int | None, size: int | None, patience: int | None) -> None:
        self.names = names
        self.columns, self.least, self.size, self.patience = columns, least, size, patience
        self.at = len(names)  # of the weight in a row that comes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = Row(*self.names, "release")
        self.rows = handle.getListState("rows", self.columns)
        self.sums = handle.getValueState("sums", "weight long, rows long, released long")

    def _left(self, released: int, n: int) -> Iterator[Row]:
        for at, r in enumerate(self.rows.get()):
            yield self.row(*r, released + (at // self.size if self.size else 0))
        self.rows.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        weight, n, released = self.sums.get() if self.sums.exists() else (0, 0, 0)
        # Each call to the state is a message to the JVM, so rows wait here in chunks; with ``size`` only what is left over goes to the state.
        waiting: list[tuple] = []
        if self.size and n:
            waiting = [tuple(r) for r in self.rows.get()]
            self.rows.clear()
        for r in rows:
            values = tuple(r)
            weight += values[self.at]
            waiting.append(values[: self.at])
            n += 1
            if n == self.size:
                yield from (self.row(*v, released) for v in waiting)
                waiting.clear()
                n, released = 0, released + 1
            elif not self.size and len(waiting) == CHUNK:
                self.rows.appendList(waiting)
                waiting.clear()
        if waiting:
            self.rows.appendList(waiting)
        if self.least is not None and weight >= self.least:
            yield from self._left(released, n)
            weight, n, released = 0, 0, released + 1
        self.sums.update((weight, n, released))
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if n:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        weight, n, released = self.sums.get()
        yield from self._left(released, n)
        self.sums.update((0, 0, released + 1))

    def close(self) -> None:
        pass


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _held(stream: DataFrame, key: str, weight: Any, least: int | None, size: int | None, patience: int | None) -> DataFrame:
    keyed_state(stream.sparkSession)
    columns = _ddl(stream)
    weighted = stream.withColumn("__weight", F.coalesce(weight, F.lit(0)).cast("long"))
    return weighted.groupBy(key).transformWithState(Held(columns, stream.columns, least, size, patience), f"{columns}, release long", "Append", "None" if patience is None else "ProcessingTime")


def until_enough(stream: DataFrame, key: str, partial: Any, least: int, patience: int | None = None) -> DataFrame:
    """Rows of a key are held until ``least`` of them are partial; then all leave under one number, and counting starts anew."""
    return _held(stream, key, F.when(partial, 1), least, None, patience)


def rechunked(stream: DataFrame, key: str, size: int, patience: int | None = None) -> DataFrame:
    """Mini-batches of ``size`` rows of a key in the order they come; ``release`` numbers them."""
    return _held(stream, key, F.lit(0), None, size, patience)


class Completed(StatefulProcessor):
    """Results of a run in the order of their times, each once; one that comes after its turn leaves at once and is marked."""

    def __init__(self, columns: str, names: list[str], id_: str, time: str, delay: float, patience: int | None) -> None:
        self.names = names
        self.columns, self.id, self.time, self.delay, self.patience = columns, id_, time, delay, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.seen = handle.getMapState("seen", "id string", "is boolean")
        self.clock = handle.getValueState("clock", "latest double, emitted double, rank long")

    def _turn(self, rows: list[dict], emitted: float, rank: int) -> Iterator[Row]:
        for values in sorted(rows, key=lambda v: (v[self.time], str(v[self.id]))):
            rank += 1
            yield Row(**values, place=rank, late=values[self.time] < emitted)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        latest, emitted, rank = self.clock.get() if self.clock.exists() else (float("-inf"), float("-inf"), 0)
        held = [dict(zip(self.names, r, strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []
        for r in rows:
            name = (str(r[self.id]),)
            if not self.seen.containsKey(name):
                self.seen.updateValue(name, (True,))
                held.append(r.asDict())
                latest = max(latest, r[self.time])
        turn = [v for v in held if v[self.time] <= latest - self.delay]
        left = [v for v in held if v[self.time] > latest - self.delay]
        yield from self._turn(turn, emitted, rank)
        emitted = max([emitted, *(v[self.time] for v in turn)])
        self._keep(left, latest, emitted, rank + len(turn))
        if self.patience is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if left:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def _keep(self, left: list[dict], latest: float, emitted: float, rank: int) -> None:
        if left:
            self.waiting.put([tuple(v.values()) for v in left])
        else:
            self.waiting.clear()
        self.clock.update((latest, emitted, rank))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        latest, emitted, rank = self.clock.get()
        held = [dict(zip(self.names, r, strict=True)) for r in self.waiting.get()]
        yield from self._turn(held, emitted, rank)
        self._keep([], latest, max([emitted, *(v[self.time] for v in held)]), rank + len(held))

    def close(self) -> None:
        pass


def in_completion_order(stream: DataFrame, run: str, id_: str, time: str, delay: float, patience: int | None = None) -> DataFrame:
    """Results of each run as they complete: ``place`` counts them by ``time`` (a double), ``late`` marks those that missed their turn.

    A result waits until one ``delay`` later is seen, or ``patience`` ms pass without another; repeats of its id are dropped.
    """
    keyed_state(stream.sparkSession)
    columns = _ddl(stream)
    mode = "None" if patience is None else "ProcessingTime"
    return stream.groupBy(run).transformWithState(Completed(columns, stream.columns, id_, time, delay, patience), f"{columns}, place long, late boolean", "Append", mode)
