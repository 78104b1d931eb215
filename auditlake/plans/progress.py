"""Progress of a scan: how many files there are, how many are done, and what was found."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FINDING_COLUMNS
from .scan import Report, Scanner


@dataclass(frozen=True)
class Progress:
    files_total: int
    files_done: int
    findings: int

    @property
    def ratio(self) -> float:
        """The share that is done, from 0 to 1; 0 where there is nothing to do."""
        return min(1.0, max(0.0, self.files_done / self.files_total)) if self.files_total > 0 else 0.0


def ratio(done: Column | str, total: Column | str) -> Column:
    d, t = (F.col(x) if isinstance(x, str) else x for x in (done, total))
    return F.when(t > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), d / t))).otherwise(0.0)


def toggled(values: Column | str, value: Column | str) -> Column:
    """A set, in order, without the value if it has it and with it if not."""
    s, v = (F.col(x) if isinstance(x, str) else x for x in (values, value))
    return F.array_sort(F.when(F.array_contains(s, v), F.array_remove(s, v)).otherwise(F.array_append(s, v)))


@contextmanager
def _tasks(spark: SparkSession, tell: Callable[[int, int], None], every: float) -> Iterator[None]:
    """Tells (done, known) of the tasks of the jobs started inside, now and then."""
    sc, group, over = spark.sparkContext, uuid.uuid4().hex, threading.Event()

    def poll() -> None:
        tracker = sc.statusTracker()
        while not over.wait(every):
            stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
            known = [i for s in stages if (i := tracker.getStageInfo(s))]
            tell(sum(i.numCompletedTasks for i in known), sum(i.numTasks for i in known))

    sc.setJobGroup(group, "scan")
    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        sc.setLocalProperty("spark.jobGroup.id", None)


def scan_with_progress(scanner: Scanner, files: DataFrame, on_progress: Callable[[Progress], None], accepted: DataFrame | None = None, every: float = 0.25, **more: DataFrame | None) -> Report:
    """A scan that tells of its progress: once before the first file, as tasks end (files in proportion to these, never falling), and once at the end with what was found."""
    total, last = files.count(), 0
    on_progress(Progress(total, 0, 0))

    def tell(done: int, known: int) -> None:
        nonlocal last
        now = int(total * done / known * 0.99) if known else 0
        if now > last:
            last = now
            on_progress(Progress(total, now, 0))

    with _tasks(scanner.spark, tell, every):
        report = scanner.scan(files, accepted, **more)
    on_progress(Progress(total, total, report.rows().select(*FINDING_COLUMNS).count()))
    return report
