"""Builds as streams of chapters: each micro-batch is extracted and written, a
build can be paused and resumed, and what it did stands in a progress table."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = "name string, run string, event string, batch bigint, n_rows bigint, at string, duration_ms bigint, error string"


class ProgressLog(StreamingQueryListener):
    """Writes a row for each start, batch and end of the queries of one name
    into a folder, a small file each, named by run and batch, so that an event
    told twice is one row."""

    def __init__(self, spark: SparkSession, path: str, name: str) -> None:
        self.spark, self.path, self.name = spark, path, name
        self.runs: set[str] = set()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.runs.add(str(event.runId))
            self._write(str(event.runId), "started", at=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            self._write(str(p.runId), "batch", p.batchId, p.numInputRows, p.timestamp, p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self.runs:
            self._write(str(event.runId), "failed" if event.exception else "ended", error=event.exception)

    def _write(self, run: str, event: str, batch: int | None = None, rows: int | None = None, at: str | None = None, took: int | None = None, error: str | None = None) -> None:
        row = {"name": self.name, "run": run, "event": event, "batch": batch, "n_rows": rows, "at": at, "duration_ms": took, "error": error}
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run}-{event}-{'' if batch is None else batch}.json")
        out = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(place, True)
        try:
            out.write(bytearray(json.dumps(row).encode()))
        finally:
            out.close()


class Build:
    """A build of chapters.  chapters: gives the stream anew at each start;
    extract: what is made of the chapters of a micro-batch.

    Its entries lie below path, a folder for each micro-batch: one that is
    interrupted runs again when the build is resumed and writes the same
    folder, so a build paused anywhere ends with the rows of an unbroken one."""

    def __init__(self, spark: SparkSession, name: str, chapters: Callable[[], DataFrame], extract: Callable[[DataFrame], DataFrame], path: str) -> None:
        self.spark, self.name, self.chapters, self.extract = spark, name, chapters, extract
        self.path, self.log_path, self.checkpoint = f"{path}/entries", f"{path}/progress", f"{path}/checkpoint"
        self.log = ProgressLog(spark, self.log_path, name)
        self.query: StreamingQuery | None = None
        spark.streams.addListener(self.log)

    def resume(self) -> StreamingQuery:
        """Starts the build, or goes on where it was paused."""
        if not self.running:

            def step(batch: DataFrame, number: int) -> None:
                self.extract(batch).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

            self.query = self.chapters().writeStream.queryName(self.name).foreachBatch(step).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        return self.query

    start = resume

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()

    def close(self) -> None:
        self.pause()
        self.spark.streams.removeListener(self.log)

    def progress(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).json(self.log_path)

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")

    def status(self, total: int) -> dict[str, int | bool]:
        """running, done, total, percent: 100 only when all is done, else 1 to
        99.  A batch that ran twice counts once."""
        latest = self.progress().where("event = 'batch'").groupBy("batch").agg(F.max("n_rows").alias("n_rows"))
        done = latest.agg(F.sum("n_rows")).first()[0] or 0
        percent = 100 if done >= total else max(1, min(99, done * 100 // total))
        return {"running": self.running, "done": done, "total": total, "percent": percent}

    def wait_for_batches(self, n: int, seconds: float = 60) -> bool:
        """Waits until so many batches are in the progress table, or the build
        has ended, or the time is up."""
        until = time.time() + seconds
        while time.time() < until:
            if self.runs_logged() and self.progress().where("event = 'batch'").select("batch").distinct().count() >= n:
                return True
            if self.query is not None and not self.query.isActive and self.query.exception() is not None:
                return False
            time.sleep(0.2)
        return False

    def runs_logged(self) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.log_path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)
