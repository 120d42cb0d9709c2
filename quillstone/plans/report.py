"""Reports of runs: numbers that are observed while the work is done, also when it is interrupted.

A run's records are dealt into batches, each batch is one distributed job, and the metrics of a
job (`DataFrame.observe`) come with it: nothing is counted again, and nothing is counted that
wasn't done. A batch that fails ends the run; its report holds what the batches before it
completed, and the reason, and the failure itself goes on to the caller.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..schema import ConfigurationError
from ..sources.scratch import written

Work = Callable[[DataFrame], DataFrame]
#: Observed of every batch, beside a run's own metrics.
DONE = "done"


@dataclass(frozen=True)
class Report:
    """What a run did. `metrics` are summed over its completed batches; `reason` is why it was interrupted."""

    operation: str
    total: int
    completed: int
    seconds: float
    batches: tuple[int, ...] = ()
    metrics: Mapping[str, int | float] = field(default_factory=dict)
    reason: str | None = None

    @property
    def per_second(self) -> float | None:
        return self.completed / self.seconds if self.seconds > 0 else None

    @property
    def interrupted(self) -> bool:
        return self.reason is not None

    def text(self) -> str:
        rate = f", {self.per_second:.1f} a second" if self.per_second is not None else ""
        own = "".join(f", {k} {v:g}" for k, v in self.metrics.items())
        end = f"; interrupted: {self.reason}" if self.interrupted else ""
        return f"{self.operation}: {self.completed} of {self.total} in {self.seconds:.1f} s{rate}{own}{end}"


def reason_of(failure: BaseException) -> str:
    """A failure in one line: its condition and what it says, without a trace."""
    said = next((line.strip() for line in str(failure).splitlines() if line.strip()), "")
    return f"{type(failure).__name__}: {said}"[:500]


def run(
    records: DataFrame, work: Work, path: str, operation: str = "embedding", batches: int = 8, batch: Column | None = None, metrics: Mapping[str, Column] | None = None,
    on_progress: Callable[[int, int], None] | None = None, on_finish: Callable[[Report], None] | None = None, clock: Callable[[], float] = time.perf_counter,
) -> Report:
    """Works through the records batch by batch, and appends what comes of each to the Parquet table at `path`.

    `metrics` are sums over the worked rows. `batch` deals the records to whole numbers from 0 to
    `batches` - 1 (by hash, if it isn't given). `on_progress` hears (completed, total) after each batch, `on_finish` the report, however the run ends.
    """
    if batches < 1:
        raise ConfigurationError("a run needs a batch")
    began = clock()
    dealt = records.withColumn("_batch", (F.pmod(F.xxhash64(*records.columns), F.lit(batches)) if batch is None else batch).cast("int"))
    before = Observation()
    parts = written(dealt.observe(before, F.count("*").alias(DONE), F.count_if(~F.coalesce(F.col("_batch").between(0, batches - 1), F.lit(False))).alias("outside")), ["_batch"])
    total, outside = before.get[DONE], before.get["outside"]
    if outside:
        raise ConfigurationError(f"{outside} records have no batch from 0 to {batches - 1}")
    sums, done, reason = dict.fromkeys(metrics or {}, 0), [], None
    completed = 0
    try:
        for number in range(batches):
            seen = Observation()
            out = work(parts.where(F.col("_batch") == number).drop("_batch"))
            own = [F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in (metrics or {}).items()]
            out.observe(seen, F.count("*").alias(DONE), *own).write.mode("append").parquet(path)
            found = seen.get
            completed += found[DONE]
            for k in sums:
                sums[k] += found[k]
            done.append(found[DONE])
            if on_progress is not None:
                on_progress(completed, total)
    except BaseException as failure:
        reason = reason_of(failure)
        raise
    finally:
        report = Report(operation, total, completed, clock() - began, tuple(done), sums, reason)
        if on_finish is not None:
            on_finish(report)
    return report


def observed(rows: DataFrame, metrics: Mapping[str, Column], action: Callable[[DataFrame], object]) -> tuple[object, dict[str, int | float]]:
    """What the action on the rows gives, and metrics (aggregates) that were observed meanwhile."""
    seen = Observation()
    result = action(rows.observe(seen, *(c.alias(k) for k, c in metrics.items())))
    return result, dict(seen.get)

