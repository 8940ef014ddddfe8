"""Progress over time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Event, Thread

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def throughput(counts: DataFrame, at: str, n: str, seconds: float) -> DataFrame:
    """counts (a row for each interval) with the running total, and what came per second since the interval before.

    A frame with a row for each interval of a report; the total needs them in one order.
    """
    w = Window.orderBy(at)
    total = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = counts.withColumn("total", total)
    return out.withColumn("per_second", ((F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0))) / seconds).cast("double"))


@contextmanager
def reported(spark: SparkSession, say: Callable[[str], None], every: float = 1.0) -> Iterator[None]:
    """Says how far running stages are while the block runs, every so many seconds, and a last time at its end."""
    tracker, done = spark.sparkContext.statusTracker(), Event()

    def line() -> str:
        stages = [x for x in map(tracker.getStageInfo, tracker.getActiveStageIds()) if x]
        return f"{len(stages)} stages, {sum(x.numCompletedTasks for x in stages)} of {sum(x.numTasks for x in stages)} tasks"

    def run() -> None:
        while not done.wait(every):
            say(line())

    thread = Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        say(line())
