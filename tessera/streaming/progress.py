"""Progress of transfers: which samples to report, with what speed, in batch and as a stream; cancelled transfers.

A sample is (key, ts in seconds, completed, total, complete). Its fraction is completed / total, within 0 and 1 (1 if complete without a total); one with the
fraction 1 that is not complete is held back, as if it had not come. Of the others these are reported:

* growth: completed is more than ever before; with bytes per second since the growth before (or the key's first sample);
* news: complete, or fewer bytes than before, or a fraction that differs by 0.001 or more from the one last reported;
* a stall: once bytes have been seen, the first sample that comes a second or more after they last grew, and then each that comes a second or more after the
  stall's report before.

What comes after a complete sample does not count. A cancel ends a transfer: if all its bytes had come, it reports its end, else nothing; later samples
do not count.

One machine for each key does both. In batch it runs down the sorted rows of a partition; in a stream its fields are the key's state, with one timer
where no sample comes. An ended transfer leaves only a mark, which goes after a time, like the state of a transfer that is not heard of any more."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOVED, HEARTBEAT = 0.001, 1.0
#: Milliseconds after which a stream forgets a transfer of which nothing is heard, and the mark of one that has ended.
FORGET = 24 * 3600 * 1000

Report = tuple[float, float, "float | None"]


def changes(samples: DataFrame, key: str = "key", ts: str = "ts", completed: str = "completed") -> DataFrame:
    """The samples whose bytes differ from the one before of their key, with the difference and bytes per second since it."""
    w = Window.partitionBy(key).orderBy(ts, completed)
    rows = samples.withColumns({"__b": F.coalesce(F.lag(completed).over(w), F.lit(0)), "__t": F.coalesce(F.lag(ts).over(w), F.col(ts))})
    delta, took = F.col(completed) - F.col("__b"), F.col(ts) - F.col("__t")
    speed = F.when(delta > 0, F.when(took > 0, delta / took).otherwise(F.lit(0.0)))
    return rows.withColumns({"delta": delta, "speed": speed}).where("delta <> 0").drop("__b", "__t")


@dataclass(frozen=True)
class Transfer:
    """A transfer after some samples. `sample`, `cancel` and `look` (no sample, but the clock) give the next state and the report, if there is one."""

    high: int = 0
    since: float | None = None
    last: float = 0.0
    stalled: float | None = None
    completed: int = 0
    total: int = 0
    ended: bool = False

    def sample(self, ts: float, completed: int, total: int, complete: bool = False) -> tuple[Transfer, Report | None]:
        if self.ended:
            return self, None
        now = replace(self, since=ts if self.since is None else self.since, completed=completed, total=total, ended=complete)
        share = min(max(completed / total, 0.0), 1.0) if total > 0 else float(complete)
        if share >= 1 and not complete:
            return now, None
        if completed > self.high:
            took = ts - now.since
            return replace(now, high=completed, since=ts, last=share, stalled=None), (ts, share, (completed - self.high) / took if took > 0 else 0.0)
        if complete or completed < self.high or abs(share - self.last) >= MOVED:
            return replace(now, last=share), (ts, share, None)
        quiet_since = now.since if self.stalled is None else self.stalled
        if self.high > 0 and ts - quiet_since >= HEARTBEAT:
            return replace(now, stalled=ts, last=share), (ts, share, None)
        return now, None

    def look(self, ts: float) -> tuple[Transfer, Report | None]:
        return (self, None) if self.since is None else self.sample(ts, self.completed, self.total)

    def cancel(self, ts: float) -> tuple[Transfer, Report | None]:
        if not self.ended and self.total > 0 and self.completed >= self.total:
            return self.sample(ts, self.completed, self.total, True)
        return replace(self, ended=True), None


def _events(samples: DataFrame, cancels: DataFrame | None, key: str) -> DataFrame:
    """(key, ts, completed, total, complete, cancel); a cancel comes after the samples of its time."""
    rows = samples.select(key, "ts", "completed", "total", F.coalesce("complete", F.lit(False)).alias("complete"), (F.col("cancel") if "cancel" in samples.columns else F.lit(False)).alias("cancel"))
    if cancels is None:
        return rows
    none = F.lit(None).cast("long")
    return rows.unionByName(cancels.select(key, "ts", none.alias("completed"), none.alias("total"), F.lit(False).alias("complete"), F.lit(True).alias("cancel")))


def reports(samples: DataFrame, key: str = "key", cancels: DataFrame | None = None) -> DataFrame:
    """All reports (key, ts, fraction, speed) of samples (key, ts, completed, total, complete) and cancels (key, ts), in batch. Memory is that of one Arrow
    batch, however many samples a key has. Samples may have their cancels among them, in a boolean column `cancel`."""
    rows = _events(samples, cancels, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, of = Transfer(), object()
        for batch in batches:
            out = []
            for k, ts, completed, total, complete, cancel in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != of:
                    machine, of = Transfer(), k
                machine, report = machine.cancel(ts) if cancel else machine.sample(ts, completed, total, complete)
                if report:
                    out.append((k, *report))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((batch.schema.field(0).type, *[pa.float64()] * 3))]
            yield pa.RecordBatch.from_arrays(columns, [key, "ts", "fraction", "speed"])

    kind = rows.schema[key].dataType.simpleString()
    ordered = rows.repartition(key).sortWithinPartitions(key, "ts", "cancel", "completed", "complete")
    return ordered.mapInArrow(run, f"{key} {kind}, ts double, fraction double, speed double")


class _Processor(StatefulProcessor):
    """Keeps a key's machine, and lets it look at the clock from one timer when no sample comes."""

    def __init__(self, forget: int, clock: bool):
        self.forget, self.clock = forget, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = "high bigint, since double, last double, stalled double, completed bigint, total bigint, ended boolean, timer bigint"
        self.kept = handle.getValueState("transfer", kept, self.forget)

    def _follow(self, key, timer, steps) -> Iterator[pd.DataFrame]:
        found = self.kept.get() if self.kept.exists() else None
        machine, due = (Transfer(*found[:7]), found[7]) if found is not None else (Transfer(), None)
        out = []
        for step in steps:
            machine, report = step(machine)
            if report:
                out.append((key[0], *report))
        if due is not None:
            self.handle.deleteTimer(due)
        due = None
        if self.clock and not machine.ended:
            due = timer.getCurrentProcessingTimeInMs() + int(1000 * HEARTBEAT)
            self.handle.registerTimer(due)
        self.kept.update((*astuple(Transfer(ended=True) if machine.ended else machine), due))
        yield pd.DataFrame(out, columns=["key", "ts", "fraction", "speed"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "cancel", "completed", "complete"], kind="stable")
        cancel = lambda ts: lambda m: m.cancel(ts)
        sample = lambda *x: lambda m: m.sample(*x)
        steps = [cancel(float(r.ts)) if r.cancel else sample(float(r.ts), int(r.completed), int(r.total), bool(r.complete)) for r in events.itertuples()]
        return self._follow(key, timerValues, steps)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() / 1000
        return self._follow(key, timerValues, [lambda m: m.look(now)])

    def close(self) -> None:
        pass


def stream_reports(samples: DataFrame, cancels: DataFrame | None = None, forget_ms: int = FORGET, clock: bool = True) -> DataFrame:
    """The same for a stream of samples (key, ts, completed, total, complete) with, or beside, a stream of cancels. Without `clock` stalls are
    only reported by samples, as in batch. Within a micro-batch rows go by ts; later ones go on from where the key is."""
    return _events(samples, cancels, "key").groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Processor(forget_ms, clock), outputStructType="key long, ts double, fraction double, speed double", outputMode="Append", timeMode="ProcessingTime"
    )


def fraction(completed: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.greatest(completed / total, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
