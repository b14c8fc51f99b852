"""Progress of jobs: whole-job fractions that never fall, as batch windows and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirefold.operators.scans import scanned

# The share of a job that each stage takes.
BANDS = {"inspect": (0.02, 0.06), "tidy": (0.06, 0.16), "photos": (0.16, 0.78), "resize": (0.16, 0.78), "verify": (0.78, 0.9), "split": (0.9, 0.99), "flatten": (0.06, 0.88)}
LEAST_MS, STALL_MS = 80, 120_000


def fraction(stage: Column, within: Column) -> Column:
    """Whole-job fraction of a stage's own 0..1."""
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(within, F.lit(0.0)), F.lit(0.0))))
    out = None
    for name, (low, high) in BANDS.items():
        value = low + (high - low) * w
        out = F.when(stage == name, value) if out is None else out.when(stage == name, value)
    return out.otherwise(w)


def creep(elapsed_ms: Column, expected_ms: Column) -> Column:
    """An estimate that nears 1 while nothing is reported."""
    return 1 - F.exp(-elapsed_ms / expected_ms)


def monotone(events: DataFrame) -> DataFrame:
    """events (job_id, ts_ms, seq, stage, within, page) with fraction, running up and rounded, the stage's epoch, and its last page."""
    run = Window.partitionBy("job_id").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = Window.partitionBy("job_id").orderBy("ts_ms", "seq")
    changed = (~F.col("stage").eqNullSafe(F.lag("stage").over(order))).cast("int")
    out = events.withColumn("value", F.max(fraction(F.col("stage"), F.col("within"))).over(run)).withColumn("changed", changed)
    out = out.withColumn("epoch", F.sum("changed").over(run))
    inside = Window.partitionBy("job_id", "epoch").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.select("job_id", "ts_ms", "seq", "stage", F.floor(F.col("value") * 1000 + 0.5).alias("permille"), "epoch", F.last("page", ignorenulls=True).over(inside).alias("page"), (F.col("changed") == 1).alias("forced"))


def throttled(events: DataFrame) -> DataFrame:
    """Of monotone events, those sent: forced ones, and others at least 80 ms after the one sent last, as a scan of each job's events in order."""

    def step(last: list, e: Any) -> list[tuple]:
        if not e.forced and last and e.ts_ms - last[0] < LEAST_MS:
            return []
        last[:] = [e.ts_ms]
        return [(e.job_id, e.ts_ms, e.seq, e.permille)]

    return scanned(events.select("job_id", "ts_ms", "seq", "forced", "permille"), ["job_id"], ["ts_ms", "seq"], list, step, "job_id long, ts_ms long, seq long, permille long")


def stalls(events: DataFrame, gap_ms: int = STALL_MS, hidden: DataFrame | None = None) -> DataFrame:
    """job_id, after_ms, gap: where a job was silent for longer than the watchdog allows.

    hidden: job_id, from_ms, to_ms of times when nobody could see it, which do not overlap; they do not count as silence.
    """
    order = Window.partitionBy("job_id").orderBy("ts_ms", "seq")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(order)
    out = events.withColumn("gap", gap).where(F.col("gap") > gap_ms).select("job_id", "seq", (F.col("ts_ms") - F.col("gap")).alias("after_ms"), "gap")
    if hidden is not None:
        away = hidden.select(F.col("job_id").alias("j"), "from_ms", "to_ms")
        both = out.join(away, (F.col("job_id") == F.col("j")) & (F.col("from_ms") < F.col("after_ms") + F.col("gap")) & (F.col("to_ms") > F.col("after_ms")), "left")
        # Where no hidden span meets a gap there is none to take off: least and greatest would skip the nulls.
        unseen = F.when(F.col("from_ms").isNotNull(), F.greatest(F.lit(0), F.least("to_ms", F.col("after_ms") + F.col("gap")) - F.greatest("from_ms", "after_ms")))
        out = both.groupBy("job_id", "seq", "after_ms", "gap").agg(F.coalesce(F.sum(unseen), F.lit(0)).alias("away")).withColumn("gap", F.col("gap") - F.col("away")).where(F.col("gap") > gap_ms)
    return out.select("job_id", "after_ms", "gap")


def current_only(events: DataFrame, current: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """events (keys, version, ...) of the version that is current (keys, version); those of an older job are stale. Events may be a stream."""
    now = current.select(*keys, F.col(version).alias("__now"))
    return events.join(now, keys).where(F.col(version) == F.col("__now")).drop("__now")


def continued(fraction_: Column, start: Column) -> Column:
    """A second pass's own fraction as that of the whole job, which the first pass left at ``start``."""
    return F.greatest(start, start + (1 - start) * fraction_)


def stream(events: DataFrame) -> DataFrame:
    """The same on a stream of (job_id, ts_ms, stage, within): job_id, ts_ms, stage, permille of what is sent.

    State of a job: the fraction reached, when something was last sent, and the stage.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, last, stage = state.get if state.exists else (0.0, None, None)
        rows = pd.concat(list(frames)).sort_values("ts_ms", kind="stable")
        out = []
        for r in rows.itertuples():
            low, high = BANDS.get(r.stage, (0.0, 1.0))
            value = max(value, low + (high - low) * min(1.0, max(0.0, r.within if r.within == r.within else 0.0)))
            if r.stage != stage or last is None or r.ts_ms - last >= LEAST_MS:
                out.append((key[0], r.ts_ms, r.stage, int(value * 1000 + 0.5)))
                last = int(r.ts_ms)
            stage = r.stage
        state.update((value, last, stage))
        yield pd.DataFrame(out, columns=["job_id", "ts_ms", "stage", "permille"])

    return events.groupBy("job_id").applyInPandasWithState(advance, "job_id long, ts_ms long, stage string, permille long", "value double, last long, stage string", "append", GroupStateTimeout.NoTimeout)
