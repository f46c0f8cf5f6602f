"""Rows of a key in event-time order, however the batches bring them.

Rows wait in state, filed by slots of event time. A timer of the key fires once the watermark has passed its earliest slot: no row of
that slot can come any more, so the slot is sorted and folded into the running state of the key. A row that arrives late but ahead of
the watermark takes its place; a row behind the watermark is dropped and counted by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.sinks import scratch
from . import ingest as si

c, lit = F.col, F.lit
ROWS = 8192  # rows folded at a time


class SlotBuffer(StatefulProcessor):
    """Buffers rows per slot; `fold(key, past, frame)` returns (result frame, new past) for the next rows in order."""

    def __init__(self, fold: Callable, order: Sequence[str], fields: Sequence[str], buffer_schema: str, past_schema: str):
        self.fold, self.order, self.fields = fold, list(order), list(fields)
        self.buffer_schema, self.past_schema = buffer_schema, past_schema

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", self.buffer_schema)
        self.past = handle.getValueState("past", self.past_schema)
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for slot, part in frame.groupby("slot_end"):
                at, new = (int(slot),), [part[x].tolist() for x in self.fields]
                if self.slots.containsKey(at):
                    new = [list(a) + b for a, b in zip(self.slots.getValue(at), new)]
                self.slots.updateValue(at, tuple(new))
                first = at[0] if first is None else min(first, at[0])
        if first is not None and (not self.alarm.exists() or first < self.alarm.get()[0]):
            self._wake(first)
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(s[0] for s in self.slots.keys())
        due = [s for s in waiting if s <= mark]
        past = self.past.get() if self.past.exists() else None
        held: list[pd.DataFrame] = []
        for s in due:
            frame = pd.DataFrame(dict(zip(self.fields, self.slots.getValue((s,)))))
            held.append(frame.sort_values(self.order, kind="stable"))
            self.slots.removeKey((s,))
            if sum(map(len, held)) >= ROWS or s == due[-1]:
                result, past = self.fold(key, past, pd.concat(held, ignore_index=True))
                held = []
                yield result
        if due:
            self.past.update(past)
            if len(due) < len(waiting):
                self._wake(waiting[len(due)])
            else:
                self.alarm.clear()

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], fields: Sequence[str], fold: Callable, past: str, out: str,
             late: str, slot_seconds: int = 3600) -> DataFrame:
    """Fold the rows of every key in the order (ts, ties). Rows without a time are left out: they have no place.

    A row may come up to `late` behind the newest time seen. State of a key: its rows of that horizon, by slots, and `past`. A slot is read and
    sorted as a whole: choose `slot_seconds` so that it holds tens to some thousands of rows of a key.
    """
    keys, order = list(keys), ["event_us", *ties]
    fields = list(dict.fromkeys([*order, *ties, *fields]))
    # frames reach the processor through named tuples, which rename columns with a leading underscore
    width = lit(slot_seconds * 1000)
    s = stream.where(c(ts).isNotNull()).withColumns({"event_us": F.unix_micros(ts), "slot_end": (F.floor(F.unix_millis(ts) / width) + 1) * width})
    kind = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    s = s.withWatermark(ts, late).select(*keys, ts, "slot_end", *[x for x in fields if x not in keys])
    buffer = ", ".join(f"{x} array<{kind[x]}>" for x in fields)
    return s.groupBy(*keys).transformWithStateInPandas(SlotBuffer(fold, order, fields, buffer, past), ", ".join(f"{x} {kind[x]}" for x in keys) + f", {out}", "append", "eventTime")


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which list and map state with timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _keyed(key, keys: Sequence[str], columns: dict) -> pd.DataFrame:
    frame = pd.DataFrame(columns)
    for at, name in enumerate(keys):
        frame.insert(at, name, [key[at]] * len(frame))
    return frame


def rolling_alarms(stream: DataFrame, key: str, ts: str, tie: str, value: str, late: str, back: int = 72, min_points: int = 6, sigma: float = 2.0, slot_seconds: int = 86400) -> DataFrame:
    """Alarms against the baseline of the `back` rows before; the state of a series is its last `back` values."""
    def fold(k, past, rows):
        old = list(past[0]) if past else []
        hist = pd.Series(old + rows[value].tolist(), dtype="float64")
        base = hist.shift(1).rolling(back, min_periods=min_points)
        mean, std = base.mean()[len(old):].to_numpy(), base.std(ddof=0)[len(old):].to_numpy()
        z = (rows[value].to_numpy(dtype="float64") - mean) / std
        hit = (std >= 1e-10) & (abs(z) >= sigma)
        return _keyed(k, [key], {tie: rows[tie].to_numpy()[hit], "sigma": z[hit]}), (hist.iloc[-back:].tolist(),)
    kind = stream.schema[tie].dataType.simpleString()
    return in_order(stream, [key], ts, [tie], [value], fold, "recent array<double>", f"{tie} {kind}, sigma double", late, slot_seconds)


def counts_since_large(stream: DataFrame, keys: Sequence[str], ts: str, tie: str, mag: str, late: str, large: float = 5.0, slot_seconds: int = 90 * 86400) -> DataFrame:
    """Small events since the last large one of each cell, emitted at every large event; the state is one counter."""
    def fold(k, past, rows):
        start = past[0] if past else 0
        big = (rows[mag] >= large).to_numpy()
        before = (~big).cumsum() + start  # small events up to here, those of earlier folds included
        at = before[big]
        since = at - pd.Series(at).shift(1, fill_value=0).to_numpy()
        return _keyed(k, list(keys), {tie: rows[tie].to_numpy()[big], "since_last": since}), (int(before[-1] - (at[-1] if len(at) else 0)),)
    kind = stream.schema[tie].dataType.simpleString()
    return in_order(stream, keys, ts, [tie], [mag], fold, "n long", f"{tie} {kind}, since_last long", late, slot_seconds)


def land_batches(spark: SparkSession, batches: Sequence[DataFrame], ts: str, horizon_days: int, name: str) -> str:
    """Folder with one part per batch, in that order, and a closing part: one row with only a time, far enough ahead that every timer fires."""
    root = scratch(spark, name)
    for part in batches:
        part.coalesce(1).write.mode("append").parquet(f"{root}/rows.parquet")
    # the newest of the batches' newest times: one number each
    ends = reduce(DataFrame.unionByName, [b.agg(F.max(ts).alias(ts)) for b in batches]).agg(F.max(ts).alias(ts)).where(c(ts).isNotNull())
    blank = [(c(ts) + F.expr(f"INTERVAL {2 * horizon_days} DAYS")).alias(ts) if f.name == ts else lit(None).cast(f.dataType).alias(f.name) for f in batches[0].schema.fields]
    ends.select(*blank).coalesce(1).write.mode("append").parquet(f"{root}/rows.parquet")
    return root


def drained(spark: SparkSession, root: str, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run `build` over the landed batches, one file a batch, and read its result back."""
    with state_on_disk(spark):
        _, out = si.run_available(build(si.landed(spark, root, "rows", files_per_batch=1)), name=name)
    return spark.read.parquet(out).drop("_batch")
