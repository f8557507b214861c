"""How an import goes: stage timings, rate, time left, and how often it commits."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "batch long, stage string, rows long, seconds double, done long, total long, rows_per_second double, eta_seconds long"
#: Shares of the old step and of the one that the rate suggests.
OLD, NEW = 0.7, 0.3


def next_step(step: int, done: int, seconds: float, target: float, least: int, most: int) -> int:
    """Rows between commits, drawn towards what the rate so far does in ``target`` seconds."""
    suggested = max(least, min(max(least, most), int(done / max(seconds, 0.001) * target)))
    return max(least, int(step * OLD + suggested * NEW))


def next_step_of(step: Column, done: Column, seconds: Column, target: float, least: Column, most: Column) -> Column:
    """``next_step`` of columns."""
    rate = done.cast("double") / F.greatest(seconds, F.lit(0.001))
    suggested = F.greatest(least, F.least(F.greatest(least, most), F.floor(rate * F.lit(target)))).cast("double")
    return F.greatest(least, F.floor(step.cast("double") * F.lit(OLD) + suggested * F.lit(NEW))).cast("long")


def rate_of(done: Column, seconds: Column) -> Column:
    """Rows a second so far, to two places; 0 before the first row."""
    return F.when(done > 0, F.round(done.cast("double") / F.greatest(seconds, F.lit(0.001)), 2)).otherwise(F.lit(0.0))


def eta_of(done: Column, total: Column, seconds: Column) -> Column:
    """Whole seconds that are left at the rate so far; null before the first row or where the total is unknown."""
    rest = F.greatest(F.lit(0).cast("long"), total.cast("long") - done.cast("long"))
    return F.when(done > 0, F.floor(rest / (done.cast("double") / F.greatest(seconds, F.lit(0.001)))))


@dataclass
class Cadence:
    """When staged rows are committed: after ``step`` rows, which follows the rate, or after ``most_seconds``."""

    step: int = 1000
    target: float = 60.0
    least: int = 50
    most: int = 1_000_000
    most_seconds: float = 180.0
    #: The steps so far, first to last.
    steps: list[int] = field(default_factory=list)
    _rows: int = 0
    _since: float = field(default_factory=time.monotonic)

    def staged(self, rows: int) -> None:
        self._rows += rows

    def observed(self, done: int, seconds: float) -> None:
        self.step = next_step(self.step, done, seconds, self.target, self.least, self.most)
        self.steps.append(self.step)

    @property
    def due(self) -> bool:
        return self._rows >= max(1, self.step) or (self._rows > 0 and time.monotonic() - self._since >= self.most_seconds)

    def committed(self) -> None:
        self._rows, self._since = 0, time.monotonic()


class ProgressListener(StreamingQueryListener):
    """Feeds a stream's observed counts to a cadence and to the metrics of its importer.

    A micro-batch is reported after it has ended, so a change of step holds from
    the batch after the next on at the latest.
    """

    def __init__(self, run_id, importer) -> None:
        self.run_id, self.importer = run_id, importer
        self.done, self.seconds = 0, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) != str(self.run_id()) or "read" not in p.observedMetrics:
            return
        rows, seconds = p.observedMetrics["read"]["rows"] or 0, p.durationMs.get("triggerExecution", 0) / 1000
        if rows:
            self.done, self.seconds = self.done + rows, self.seconds + seconds
            self.importer.observed(p.batchId, rows, seconds, self.done, self.seconds)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
