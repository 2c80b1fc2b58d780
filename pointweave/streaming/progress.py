"""Remaining time of trainings from their progress, in batch and as a stream.

The rules: an observation counts if its counter moved.  A new run begins when the
counter falls, its total changes or nothing came for 45 seconds, and after a line
that is no progress.  The rate is the median of the last five rates, once
observations spread over at least two seconds and no two rates differ by more
than half.  Rates are those that the lines print, if the latest three lines or
more print one, else those observed between lines.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

MAX_GAP = 45.0
LEAST_SPAN = 2.0
LEAST_SAMPLES, KEPT, MOST_SPREAD = 3, 5, 1.5
#: How a trainer's progress lines look.
COUNTER = r"(?:Training progress:|Optimizing splats)\s*.*?(\d+)\s*/\s*(\d+)"
RATE = r"([0-9]+(?:\.[0-9]+)?)\s*(it/s|s/it)"


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with iteration, total and printed rate; other lines, and counters at or beyond their total, have nulls."""
    number = lambda i: F.expr(f"try_cast(regexp_extract({line}, r'{COUNTER}', {i}) AS BIGINT)")
    value, unit = F.expr(f"try_cast(regexp_extract({line}, r'{RATE}', 1) AS DOUBLE)"), F.regexp_extract(line, RATE, 2)
    rate = F.when(value > 0, F.when(unit == "it/s", value).otherwise(1 / value))
    parsed = lines.withColumns({"iteration": number(1), "total": number(2), "printed": rate})
    usable = (F.col("iteration") >= 0) & (F.col("iteration") < F.col("total"))
    return parsed.withColumns({c: F.when(usable, F.col(c)) for c in ("iteration", "total", "printed")})


def track(samples: DataFrame, job: str = "job_id", at: str = "at") -> DataFrame:
    """Samples (job, at seconds, iteration, total, and printed if there is one) with run, rate, eta, stable and basis.

    Windows over a job's own samples: repeats of a counter fall out first, then
    gaps and restarts number the runs, and five rows back decide.  A sample
    without a counter ends its run and gives no row.
    """
    printed = F.col("printed") if "printed" in samples.columns else F.lit(None).cast("double")
    w = Window.partitionBy(job).orderBy(at, "iteration")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    breaks = samples.withColumn("__print", printed).withColumn("__breaks", F.sum(F.col("iteration").isNull().cast("int")).over(upto))
    rows = breaks.where(F.col("iteration").isNotNull())
    w = Window.partitionBy(job, "__breaks").orderBy(at, "iteration")
    moved = rows.withColumn("__p", F.lag("iteration").over(w)).withColumn("__t", F.lag("total").over(w))
    moved = moved.where(F.col("__p").isNull() | (F.col("__p") != F.col("iteration")) | (F.col("__t") != F.col("total")))
    before = moved.withColumns({"__p": F.lag("iteration").over(w), "__t": F.lag("total").over(w), "__a": F.lag(at).over(w)})
    fresh = F.col("__p").isNull() | (F.col("__t") != F.col("total")) | (F.col("iteration") < F.col("__p")) | (F.col(at) - F.col("__a") > MAX_GAP)
    all_of_job = Window.partitionBy(job).orderBy(at, "iteration").rowsBetween(Window.unboundedPreceding, 0)
    runs = before.withColumn("__fresh", fresh).withColumn("run", F.sum(F.col("__fresh").cast("int")).over(all_of_job))
    step = F.when(~F.col("__fresh") & (F.col(at) > F.col("__a")), (F.col("iteration") - F.col("__p")) / (F.col(at) - F.col("__a")))
    inside = Window.partitionBy(job, "run").orderBy(at, "iteration")
    since = inside.rowsBetween(Window.unboundedPreceding, 0)
    rated = runs.withColumns({"__step": step, "__first": F.min(at).over(since), "__silent": F.sum(F.col("__print").isNull().cast("int")).over(since)})

    def last(name: str, window) -> dict:
        recent = window.rowsBetween(1 - KEPT, 0)
        return {f"{name}_n": F.count(name).over(recent), f"{name}_lo": F.min(name).over(recent), f"{name}_hi": F.max(name).over(recent), f"{name}_med": F.percentile(name, F.lit(0.5)).over(recent)}

    rated = rated.withColumns(last("__step", inside)).withColumns(last("__print", Window.partitionBy(job, "run", "__silent").orderBy(at, "iteration")))
    printing = F.col("__print_n") >= LEAST_SAMPLES
    of = lambda k: F.when(printing, F.col(f"__print_{k}")).otherwise(F.col(f"__step_{k}"))
    stable = (F.col(at) - F.col("__first") >= LEAST_SPAN) & (of("n") >= LEAST_SAMPLES) & (of("lo") > 0) & (of("hi") <= MOST_SPREAD * of("lo"))
    out = rated.withColumns({"stable": F.coalesce(stable, F.lit(False)), "__rate": of("med")})
    basis = F.when(~F.col("stable"), "collecting").when(printing, "printed_rate").otherwise("observed_intervals")
    return out.select(*samples.columns, "run", "stable", F.when(F.col("stable"), F.col("__rate")).alias("rate"), F.when(F.col("stable"), (F.col("total") - F.col("iteration")) / F.col("__rate")).alias("eta"), basis.alias("basis"))


def recent_step_eta(steps: DataFrame, job: str, order: str, seconds: str, remaining: str, k: int = 10) -> DataFrame:
    """``steps`` with eta: the mean of the last ``k`` step times, times the steps that remain."""
    w = Window.partitionBy(job).orderBy(order).rowsBetween(1 - k, 0)
    return steps.withColumn("eta", F.avg(seconds).over(w) * F.col(remaining))


@dataclass(frozen=True)
class Run:
    """The observations of a training since it last began anew: the first time, and the latest ones, oldest first."""

    total: int
    first_at: float
    times: tuple[float, ...]
    counters: tuple[int, ...]
    printed: tuple[float | None, ...]

    def follows(self, at: float, iteration: int, total: int) -> bool:
        return total == self.total and iteration >= self.counters[-1] and at - self.times[-1] <= MAX_GAP

    def repeats(self, iteration: int, total: int) -> bool:
        return total == self.total and iteration == self.counters[-1]

    def with_one(self, at: float, iteration: int, printed: float | None) -> Run:
        keep = slice(-KEPT, None)  # and the new one: KEPT steps
        return Run(self.total, self.first_at, (*self.times[keep], at), (*self.counters[keep], iteration), (*self.printed[keep], printed))

    def rates(self) -> tuple[str, list[float]]:
        """The latest rates and where they are from."""
        said = []
        for value in reversed(self.printed[-KEPT:]):
            if value is None:
                break
            said.append(value)
        if len(said) >= LEAST_SAMPLES:
            return "printed_rate", said
        seen = list(zip(self.times, self.counters))
        return "observed_intervals", [(n - m) / (t - s) for (s, m), (t, n) in zip(seen, seen[1:]) if t > s][-KEPT:]

    def estimate(self) -> tuple:
        """(iteration, total, rate, eta, basis)."""
        basis, rates = self.rates()
        steady = len(rates) >= LEAST_SAMPLES and 0 < max(rates) <= MOST_SPREAD * min(rates)
        if not steady or self.times[-1] - self.first_at < LEAST_SPAN:
            return self.counters[-1], self.total, None, None, "collecting"
        rate = statistics.median(rates)
        return self.counters[-1], self.total, rate, (self.total - self.counters[-1]) / rate, basis


def observe(run: Run | None, at: float, iteration: int | None, total: int | None, printed: float | None) -> tuple[Run | None, tuple | None]:
    """(the run after a line, its estimate); no estimate for a line that is no progress or repeats the counter."""
    if iteration is None or total is None:
        return None, None
    if run and run.repeats(iteration, total):
        return run, None
    if run and run.follows(at, iteration, total):
        run = run.with_one(at, iteration, printed)
    else:
        run = Run(total, at, (at,), (iteration,), (printed,))
    return run, run.estimate()


STATE = "total long, first_at double, times array<double>, counters array<long>, printed array<double>"
OUTPUT = "job_id string, at double, iteration long, total long, rate double, eta double, basis string"
NAMES = ["job_id", "at", "iteration", "total", "rate", "eta", "basis"]
STATE_TTL_MS = 3_600_000


class ProgressProcessor(StatefulProcessor):
    """``observe`` per job, for ``transformWithStateInPandas``.

    A job of which nothing came for 45 seconds gets one row with basis ``stale``
    and no estimate; state that nothing touches for an hour expires.
    """

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("run", STATE, STATE_TTL_MS)

    def _held(self) -> Run | None:
        if not self.state.exists():
            return None
        total, first_at, *rest = self.state.get()
        return Run(total, first_at, *map(tuple, rest))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run, out = self._held(), []
        for at, iteration, total, printed in pd.concat(list(rows)).sort_values("at", kind="stable")[["at", "iteration", "total", "printed"]].itertuples(index=False):
            a, b, c = (None if pd.isna(x) else x for x in (iteration, total, printed))
            run, found = observe(run, float(at), a if a is None else int(a), b if b is None else int(b), c)
            if found:
                out.append((key[0], float(at), *found))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if run is None:
            self.state.clear()
        else:
            self.state.update(astuple(run))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * MAX_GAP))
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run = self._held()
        rows = [(key[0], run.times[-1], run.counters[-1], run.total, None, None, "stale")] if run else []
        yield pd.DataFrame(rows, columns=NAMES)

    def close(self) -> None:
        pass


def stream(lines: DataFrame) -> DataFrame:
    """The estimates of a streaming frame of (job_id, at, line); needs the RocksDB state store."""
    parsed = parse_lines(lines).select("job_id", "at", "iteration", "total", "printed")
    return parsed.groupBy("job_id").transformWithStateInPandas(ProgressProcessor(), OUTPUT, "Append", "ProcessingTime")
