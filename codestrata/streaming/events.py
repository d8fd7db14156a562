"""File events: debounce, line-count filter and batch windows, as batch plans and as streaming operators.

An event has path, event (add, change, unlink, unlinkDir), ts, mtime, size and lines. The batch forms replay a log by
event time and are what SQL can check; the streaming forms hold the same state per path.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window


def debounced(events: DataFrame, key: str, ts: str, delay: str, *ties: str) -> DataFrame:
    """Events that no other of their key follows within `delay` (an interval): the last of each burst."""
    by = Window.partitionBy(key).orderBy(ts, *ties)
    after = F.lead(ts).over(by)
    return events.withColumn("__next", after).where(F.col("__next").isNull() | (F.col("__next") - F.col(ts) > F.expr(f"interval {delay}"))).drop("__next")


def changed_enough(events: DataFrame, key: str, order: str, lines: Column, least: int) -> DataFrame:
    """Events whose line count differs from the one before by at least `least`; a key's first event passes. The
    baseline moves with every event, also with one that doesn't pass."""
    by = Window.partitionBy(key).orderBy(order)
    return events.withColumn("__delta", F.abs(lines - F.lag(lines).over(by))).where(F.col("__delta").isNull() | (F.col("__delta") >= least)).drop("__delta")


def batch_windows(events: DataFrame, key: str, ts_seconds: str, path: str, length: int) -> DataFrame:
    """(key, window_start, paths): a window opens with the first event outside the last one, lasts `length` seconds
    and holds each path once. Windows of a key depend on all its earlier ones, so a key is walked in order, from
    (second, path) pairs already made distinct."""
    pairs = events.select(F.col(key).cast("string").alias("key"), F.col(ts_seconds).cast("bigint").alias("at"), F.col(path).cast("string").alias("path")).distinct()

    def walk(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "path"])
        start, starts = None, []
        for t in pdf["at"]:
            if start is None or t >= start + length:
                start = int(t)
            starts.append(start)
        out = pdf.assign(window_start=starts).drop_duplicates(["window_start", "path"])
        out = out.groupby("window_start", as_index=False)["path"].agg(lambda p: sorted(p))
        return pd.DataFrame({"key": group[0], "window_start": out["window_start"], "paths": out["path"]})

    return pairs.groupBy("key").applyInPandas(walk, "key string, window_start bigint, paths array<string>")


EVENT = "path string, event string, ts timestamp, mtime double, size bigint, lines int"


def _plain(x) -> tuple:
    """mtime, size and lines of an event; what is missing is None."""
    pick = lambda v, kind: None if pd.isna(v) else kind(v)
    return pick(x["mtime"], float), pick(x["size"], int), pick(x["lines"], int)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["path", "event", "ts", "mtime", "size", "lines"])
    return out.astype({"ts": "datetime64[us]", "mtime": "Float64", "size": "Int64", "lines": "Int32"})


def debounce_stream(events: DataFrame, delay_ms: int) -> DataFrame:
    """The last event of each path once no other has come for delay_ms of processing time."""

    def step(key, batches, state):
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield _frame([(key[0], held[0], _time(held[1]), *held[2:])])
            return
        last = state.get if state.exists else None
        for x in _sorted(batches):
            micros = _micros(x.ts)
            if last is None or last[1] is None or micros is not None and micros >= last[1]:
                last = (x.event, micros, *_plain(x))
        if last is not None:
            state.update(last)
            state.setTimeoutDuration(delay_ms)

    return events.groupBy("path").applyInPandasWithState(step, EVENT, "event string, ts bigint, mtime double, size bigint, lines int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _sorted(batches) -> list:
    """The events of one path in order of time, those without one first."""
    whole = pd.concat(list(batches))
    return [x for _, x in whole.sort_values("ts", na_position="first", kind="stable").iterrows()]


def _micros(ts) -> int | None:
    return None if pd.isna(ts) else int(ts.value // 1000)


def _time(micros: int | None):
    return pd.NaT if micros is None else pd.Timestamp(micros, unit="us")


def admitted(seen: tuple | None, event: str, now: tuple, least: int) -> tuple[bool, tuple | None]:
    """(whether an event passes, what is seen after it). seen and now: mtime, size, lines; None where unknown.

    A deletion passes and forgets, so a file that comes back is new. An addition or change with the mtime last seen is
    dropped, and so is a change whose line count moved by less than `least`; the baseline moves all the same. An unknown
    mtime equals none, an unknown line count passes.
    """
    if event in ("unlink", "unlinkDir"):
        return True, None
    if seen is not None and now[0] is not None and seen[0] == now[0]:
        return False, seen
    known = seen is not None and seen[2] is not None and now[2] is not None
    return not (known and event == "change" and abs(now[2] - seen[2]) < least), now


def change_stream(events: DataFrame, least: int, delay_ms: int = 0) -> DataFrame:
    """The admitted() events of a stream; with a delay only the last of each burst is considered, once delay_ms of
    processing time have passed without another. Deletions go at once and take what waits with them."""

    def step(key, batches, state):
        held, seen = None, None
        if state.exists:
            s = state.get
            held, seen = (tuple(s[1:6]) if s[0] else None), (tuple(s[7:10]) if s[6] else None)
        out = []

        def decide(event, micros, now):
            nonlocal seen
            passes, seen = admitted(seen, event, now, least)
            if passes:
                out.append((key[0], event, _time(micros), *now))

        if state.hasTimedOut:
            if held is not None:
                decide(held[0], held[1], held[2:])
            held = None
        else:
            for x in _sorted(batches):
                event, micros, now = x.event, _micros(x.ts), _plain(x)
                if event in ("unlink", "unlinkDir") or not delay_ms:
                    held = None
                    decide(event, micros, now)
                else:
                    held = (event, micros, *now)
        if held is None and seen is None:
            if state.exists:
                state.remove()
        else:
            state.update((held is not None, *(held or (None,) * 5), seen is not None, *(seen or (None,) * 3)))
            if held is not None:
                state.setTimeoutDuration(delay_ms)
        yield _frame(out)

    kind = "held boolean, event string, ts bigint, mtime double, size bigint, lines int, known boolean, seen_mtime double, seen_size bigint, seen_lines int"
    timer = GroupStateTimeout.ProcessingTimeTimeout if delay_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("path").applyInPandasWithState(step, EVENT, kind, "append", timer)


def _plain(x) -> tuple:
    """mtime, size and lines of an event; what is missing is None."""
    pick = lambda v, kind: None if pd.isna(v) else kind(v)
    return pick(x["mtime"], float), pick(x["size"], int), pick(x["lines"], int)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["path", "event", "ts", "mtime", "size", "lines"])
    return out.astype({"ts": "datetime64[us]", "mtime": "Float64", "size": "Int64", "lines": "Int32"})


class Watcher:
    """Runs a stream of events into update(paths) and delete(paths, directories), one batch at a time.

    Events are debounced by debounce_ms and filtered by change_stream(); a batch lasts batch_minutes, and its last event
    of a path decides. A run with `once` takes what is there, without the timer.
    """

    def __init__(self, events: DataFrame, update: Callable[[list[str]], None], delete: Callable[[list[str], list[str]], None], checkpoint: str, batch_minutes: float = 10, least_lines: int = 5, debounce_ms: int = 500):
        self.events, self.update, self.delete = events, update, delete
        self.checkpoint, self.minutes, self.least, self.debounce = checkpoint, batch_minutes, least_lines, debounce_ms
        self.query = None

    def drain(self, batch: DataFrame, _id: int) -> None:
        """The last event of each path decides; deletions go first, so a path that is gone isn't updated. A batch's
        paths, not its files, come to the driver, which starts the incremental run for them."""
        by = Window.partitionBy("path").orderBy(F.desc_nulls_last("ts"), F.desc("event"))
        last = batch.withColumn("__r", F.row_number().over(by)).where("__r = 1").select("path", "event").collect()
        gone, folders = [r.path for r in last if r.event == "unlink"], [r.path for r in last if r.event == "unlinkDir"]
        if gone or folders:
            self.delete(sorted(gone), sorted(folders))
        changed = sorted(r.path for r in last if r.event in ("add", "change") and not any(r.path.startswith(f.rstrip("/") + "/") for f in folders))
        if changed:
            self.update(changed)

    def start(self, once: bool = False):
        if self.query is not None:
            raise RuntimeError("this watcher runs already")
        flow = change_stream(self.events, self.least, 0 if once else self.debounce)
        writer = flow.writeStream.foreachBatch(self.drain).option("checkpointLocation", self.checkpoint)
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(int(self.minutes * 60_000), 1)} milliseconds")
        self.query = writer.start()
        return self.query

    def stop(self, most_seconds: float = 60) -> None:
        """Processes what has arrived, then stops. With a timer a query never runs out of batches, so there it waits for one
        without data, most_seconds at most; what the timer still holds is in the checkpoint and goes on after a restart."""
        if self.query is not None:
            if self.query.isActive and not self.query.exception():
                if not self.debounce:
                    self.query.processAllAvailable()
                end = time.time() + most_seconds
                while self.debounce and time.time() < end and self.query.isActive and (self.query.status["isDataAvailable"] or self.query.status["isTriggerActive"]):
                    time.sleep(0.2)
            self.query.stop()
            self.query = None
