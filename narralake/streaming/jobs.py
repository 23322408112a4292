"""Scheduled jobs on the driver: what runs when, and a loop that survives failures."""

from __future__ import annotations

import datetime
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from narralake.operators import consistency, temporal
from narralake.plans.adapter import Story
from narralake.plans.storage import written

#: Seconds between runs, or (hour, minute) of the day in UTC.
SCHEDULE: dict[str, float | tuple[int, int]] = {
    "temporal-contradiction-detection": 30.0,
    "cleanup-old-contradictions": 6 * 3600.0,
    "nightly-relationship-evolution-scan": (2, 0),
    "nightly-continuity-validation": (2, 30),
}
SCAN_SECONDS, RETRY_MOST = 30, 300


def next_run(when: float | tuple[int, int], last: datetime.datetime) -> datetime.datetime:
    """The first due time after `last`; periods of whole hours fall on hours that they divide."""
    if isinstance(when, tuple):
        today = last.replace(hour=when[0], minute=when[1], second=0, microsecond=0)
        return today if today > last else today + datetime.timedelta(days=1)
    if when % 3600 == 0:
        day = last.replace(hour=0, minute=0, second=0, microsecond=0)
        return day + datetime.timedelta(seconds=((last - day).total_seconds() // when + 1) * when)
    return last + datetime.timedelta(seconds=when)


def retry_delay(interval: int) -> int:
    return min(RETRY_MOST, interval // 12)


class Job:
    """Runs `work` every `interval` seconds, or at a time of the day (hour, minute), until it is stopped; after a failure it
    tries again sooner."""

    def __init__(self, work: Callable[[], Any], interval: float | tuple[int, int] = SCAN_SECONDS):
        self.work, self.interval, self.runs, self.failures, self.last_error = work, interval, 0, 0, ""
        self._stopped, self._thread = threading.Event(), None

    def run_once(self) -> bool:
        try:
            self.work()
            self.runs += 1
            return True
        except Exception as error:  # the work is foreign code
            self.failures += 1
            self.last_error = str(error)
            return False

    def _pause(self, ok: bool) -> float:
        if isinstance(self.interval, tuple):
            now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
            return (next_run(self.interval, now) - now).total_seconds() if ok else RETRY_MOST
        return self.interval if ok else retry_delay(int(self.interval))

    def _loop(self) -> None:
        ok = True
        if isinstance(self.interval, tuple):
            self._stopped.wait(self._pause(True))
        while not self._stopped.is_set():
            ok = self.run_once()
            self._stopped.wait(self._pause(ok))

    def start(self) -> bool:
        """False if it runs already."""
        if self._thread and self._thread.is_alive():
            return False
        self._stopped.clear()
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()
        return True

    def stop(self) -> None:
        self._stopped.set()
        if self._thread:
            self._thread.join(timeout=60)

    def status(self) -> dict[str, Any]:
        return {"is_running": bool(self._thread and self._thread.is_alive()), "interval": self.interval, "runs": self.runs, "failures": self.failures, "last_error": self.last_error}


def bound(g: Story, folder: str, detected_at: str, keep_days: int = 30) -> dict[str, Job]:
    """The scheduled jobs over a graph, by name. Findings and reports are tables under the folder: what a scan finds anew is
    appended to `contradictions` with the time `detected_at`; the clean-up writes those that aren't older than `keep_days`
    before it to a table of their own, which is read from then on; the nightly scans replace their reports."""
    spark, found = g.spark, f"{folder.rstrip('/')}/contradictions"
    at = F.lit(detected_at).cast("timestamp_ntz")
    schema = "rule string, character_id long, from_id string, to_id string, severity string, reason string, confidence double, detected_at timestamp_ntz"
    spark.createDataFrame([], schema).write.mode("append").parquet(found)

    def scan() -> None:
        new = consistency.unified(g, consistency.LISTED).withColumn("detected_at", at)
        had = spark.read.schema(schema).parquet(found).select("rule", "from_id", "to_id")
        new.join(had, ["rule", "from_id", "to_id"], "left_anti").write.mode("append").parquet(found)

    def clean_up() -> None:
        kept = written(spark.read.schema(schema).parquet(found).filter(F.col("detected_at") >= at - F.expr(f"INTERVAL {keep_days} DAYS")), "kept")
        kept.write.mode("overwrite").parquet(found)

    report = lambda rows, name: rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
    works = {
        "temporal-contradiction-detection": scan,
        "cleanup-old-contradictions": clean_up,
        "nightly-relationship-evolution-scan": lambda: report(temporal.milestones_tension_spikes(g), "relationship_evolution"),
        "nightly-continuity-validation": lambda: report(temporal.unresolved_foreshadows(g), "unresolved_foreshadows"),
    }
    return {name: Job(works[name], when) for name, when in SCHEDULE.items()}
