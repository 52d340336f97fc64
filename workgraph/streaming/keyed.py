"""Keyed state whose rows are taken in order, however many of one key come in a batch.

A key's state is in variables of its own (values and maps, with a time to live), kept by Spark's state store. Rows of a key
that come in one Arrow batch are sorted there; more of them are sorted piece by piece, put by in a map of the state, and
merged block by block: memory holds a block of each piece, and not the rows of the key.

A key of its own costs a stream milliseconds a batch, however few rows it has. So keys without timers share BUCKETS keys of
Spark's, by hash: a bucket's states are one value, read and written once a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a block that is put by.
BLOCK = 1000
#: Keys that a stream's states are dealt over, and the column that holds their number.
BUCKETS, BUCKET = 1024, "_bucket"


def _bytes(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _frame(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class Sorter:
    """Frames of one key as frames in the order of a column whose values are all different."""

    def __init__(self, blocks, order: str, block: int = BLOCK) -> None:
        self.blocks, self.order, self.block = blocks, order, block

    def sorted(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = next(frames, None)
        if first is None:
            return
        second = next(frames, None)
        if second is None:
            yield first.sort_values(self.order)
            return
        left: list[tuple[int, int]] = []  # of each piece: the next block, and how many there are
        for piece, f in enumerate(self._all(first, second, frames)):
            f = f.sort_values(self.order)
            starts = range(0, len(f), self.block)
            for k, at in enumerate(starts):
                self.blocks.updateValue((piece, k), (_bytes(f.iloc[at : at + self.block]),))
            left.append((0, len(starts)))
        yield from self._merged(left)

    @staticmethod
    def _all(first: pd.DataFrame, second: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield first
        yield second
        yield from rest

    def _merged(self, left: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        """What no piece has anything before: rows up to the least of the last rows of the pieces' current blocks."""
        heads = {piece: self._take(piece, 0) for piece, (_, n) in enumerate(left) if n}
        following = dict.fromkeys(heads, 1)
        while heads:
            bound = min(f[self.order].iloc[-1] for f in heads.values())
            yield pd.concat([f[f[self.order] <= bound] for f in heads.values()]).sort_values(self.order)
            for piece in list(heads):
                heads[piece] = heads[piece][heads[piece][self.order] > bound]
                while piece in heads and not len(heads[piece]):
                    if following[piece] == left[piece][1]:
                        del heads[piece]
                    else:
                        heads[piece] = self._take(piece, following[piece])
                        following[piece] += 1

    def _take(self, piece: int, k: int) -> pd.DataFrame:
        data = self.blocks.getValue((piece, k))[0]
        self.blocks.removeKey((piece, k))
        return _frame(data)


class Ordered(StatefulProcessor):
    """A fold over the rows of each key in order: step(key, row, held) -> (held, row or None), None for what is held by no key.
    due(held) is the time in ms at which a key's state ends by itself, and ended(key, held) the rows that this gives."""

    def __init__(self, step: Callable, take: list[str], names: list[str], state: str, order: str, ttl: int | None, due: Callable, ended: Callable) -> None:
        self.step, self.take, self.names, self.state, self.order, self.ttl, self.due, self.ended = step, take, names, state, order, ttl, due, ended

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state, self.ttl)
        self.sorter = Sorter(handle.getMapState("blocks", "piece int, block int", "rows binary", self.ttl), self.order)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was = held = tuple(self.held.get()) if self.held.exists() else None
        for frame in self.sorter.sorted(rows):
            out = []
            for row in zip(*(frame[c].tolist() for c in self.take), strict=True):
                held, told = self.step(key, row, held)
                if told is not None:
                    out.append(told)
            if out:
                yield pd.DataFrame(out, columns=self.names)
        if held is not None:
            self.held.update(held)
        elif was is not None:
            self.held.clear()
        if was is not None:
            self.handle.deleteTimer(self.due(was))
        if held is not None:
            self.handle.registerTimer(self.due(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else None
        if held is not None and self.due(held) <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield pd.DataFrame(self.ended(key, held), columns=self.names)

    def close(self) -> None:
        pass


class Held:
    """The states of a bucket's keys, as one value of text: of each key its state and, with a time to live, when it was written."""

    def __init__(self, handle: StatefulProcessorHandle, ttl: int | None) -> None:
        self.value, self.ttl = handle.getValueState("bucket", "states string", ttl), ttl

    def load(self, timerValues) -> dict[tuple, tuple]:
        self.now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        self.was = {}
        if self.value.exists():
            self.was = {tuple(k): (s, at) for k, s, at in json.loads(self.value.get()[0]) if not self.ttl or at + self.ttl > self.now}
        return {k: tuple(s) for k, (s, _) in self.was.items()}

    def save(self, states: dict[tuple, tuple], touched: set[tuple]) -> None:
        if states:
            self.value.update((json.dumps([(k, s, self.now if k in touched else self.was[k][1]) for k, s in states.items()]),))
        else:
            self.value.clear()


class Bucketed(StatefulProcessor):
    """Ordered without timers, for all keys of a bucket at once."""

    def __init__(self, step: Callable, keys: list[str], take: list[str], names: list[str], order: str, ttl: int | None) -> None:
        self.step, self.keys, self.take, self.names, self.order, self.ttl = step, keys, take, names, order, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = Held(handle, self.ttl)
        self.sorter = Sorter(handle.getMapState("blocks", "piece int, block int", "rows binary", self.ttl), self.order)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states, touched = self.held.load(timerValues), set()
        for frame in self.sorter.sorted(rows):
            out = []
            own = zip(*(frame[c].tolist() for c in self.keys), strict=True)
            for k, row in zip(own, zip(*(frame[c].tolist() for c in self.take), strict=True), strict=True):
                held, told = self.step(k, row, states.get(k))
                if held is not None:
                    states[k] = held
                    touched.add(k)
                else:
                    states.pop(k, None)
                if told is not None:
                    out.append(told)
            if out:
                yield pd.DataFrame(out, columns=self.names)
        self.held.save(states, touched)

    def close(self) -> None:
        pass


def ordered_fold(df: DataFrame, keys: list[str], step: Callable, out: str, state: str, order: str, idle_ms: int | None = None, due: Callable | None = None, ended: Callable | None = None) -> DataFrame:
    """A stream df by keys, which are text, through step(key, row, held), row by row in order; row holds df's other columns. With
    idle_ms, state that was not written for so long is gone, whether or not its key comes again; due and ended let it end at
    a time of its own, in a batch that may have no rows, which needs a key of Spark's for each."""
    names = [c.split()[0] for c in out.split(", ")]
    take = [c for c in df.columns if c not in keys]
    if due is None:
        return bucketed(df, keys, Bucketed(step, keys, take, names, order, idle_ms), out, idle_ms is not None)
    return keyed(df, keys, Ordered(step, take, names, state, order, idle_ms, due, ended), out, True)


def bucketed(df: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, timed: bool) -> DataFrame:
    """A stream df by buckets of its keys through a processor."""
    return keyed(df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")), [BUCKET], processor, out, timed)


def keyed(df: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, timed: bool) -> DataFrame:
    """A stream df by keys through a processor. State variables need the RocksDB store, which the session is set to."""
    df.sparkSession.conf.set(STORE, ROCKS)
    return df.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "ProcessingTime" if timed else "None")
