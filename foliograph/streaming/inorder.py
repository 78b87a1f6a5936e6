"""Rows of a key in event-time order, whatever micro-batch brings them.

Rows wait in state until the watermark has passed their time; then they are handled in order of (time, sequence number), once. Rows
that come after that are late and Spark drops them. A row without a sequence number says only how late it is: it moves the watermark. A key at rest for `idle` longer than its last row is forgotten. So nothing depends
on how the input was cut into micro-batches, and state ends.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain(value: object, kind: str = "") -> object:
    """A pandas cell as a state value of a DDL type: null for missing ones, microseconds for times, whole numbers as such."""
    if value is None or value is pd.NaT or value != value:  # noqa: PLR0124
        return None
    if isinstance(value, pd.Timestamp):
        return value.value // 1000
    return int(value) if kind in ("int", "long") else value.item() if hasattr(value, "item") else value


class InOrder(StatefulProcessor):
    """`columns` of the waiting rows (DDL), the first two of them t (microseconds) and seq; `out` names the result's columns. `idle` is in
    milliseconds. Subclasses give `begin` (their own state), `step` and `forget`."""

    columns: str
    out: Sequence[str]

    def __init__(self, idle: int):
        self.idle = idle

    def begin(self, handle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, rows: Sequence[tuple]) -> list[tuple]:
        """Result rows of waiting rows that are due, in order."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")  # packed: a call of the state for every row costs more than the row
        self.last = handle.getValueState("last", "ms long")
        self.names, self.kinds = zip(*(c.split() for c in self.columns.split(", ")), strict=True)
        self.begin(handle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            new = [tuple(map(plain, r, self.kinds)) for r in frame[list(self.names)].itertuples(index=False, name=None) if r[1] == r[1] and r[1] is not None]
            if new:
                self.waiting.appendValue((pickle.dumps(new),))
                first = min([r[0] // 1000 for r in new] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((r for packed in self.waiting.get() for r in pickle.loads(packed[0])), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        due = [r for r in rows if r[0] // 1000 < now]
        later = [r for r in rows if r[0] // 1000 >= now]
        last = self.last.get()[0] if self.last.exists() else None
        if due:
            if later:
                self.waiting.put([(pickle.dumps(later),)])
            else:
                self.waiting.clear()
            last = max(due[-1][0] // 1000, last or 0)
            self.last.update((last,))
        if later:
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        elif due:
            self.handle.registerTimer(last + self.idle)
        elif last is not None and now >= last + self.idle:
            self.forget()
            self.last.clear()
        found = self.step(key, due) if due else []
        if found:
            yield pd.DataFrame(found, columns=list(self.out))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str | Sequence[str], processor: InOrder, schema: str, delay: str, time: str = "") -> DataFrame:
    """`processor` over `rows` by `key`, in event time `t` with rows up to `delay` late. `time` is the result's event time where another step
    with state follows."""
    conf = rows.sparkSession.conf
    if conf.get(PROVIDER, "") != ROCKSDB:
        conf.set(PROVIDER, ROCKSDB)  # the only store that keeps several states and timers a key
    keys = [key] if isinstance(key, str) else key
    return rows.withWatermark("t", delay).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime", eventTimeColumnName=time)
