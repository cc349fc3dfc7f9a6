"""Jobs that end at a deadline or on demand, and leave nothing behind."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from quire import session


class Cancelled(Exception):
    """A job was ended before it was done."""


class Job:
    """A handle that other threads may cancel."""

    def __init__(self, spark: SparkSession, seconds: float | None):
        self.spark, self.seconds, self.tag = spark, seconds, f"quire-{uuid.uuid4().hex}"
        self.reason: str | None = None
        self._changed, self._over = threading.Event(), threading.Event()

    def cancel(self, reason: str = "cancelled") -> None:
        self.reason = self.reason or reason
        self._changed.set()

    def _watch(self) -> None:
        if not self._changed.wait(self.seconds):
            self.reason = f"took more than {self.seconds:g} seconds"
        # again and again: what the job starts after the first interrupt is ended too
        while not self._over.is_set():
            if self.reason:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._over.wait(0.2)


@contextmanager
def job(spark: SparkSession, seconds: float | None = None) -> Iterator[Job]:
    """What this thread runs inside is tagged, ended after `seconds` or by the handle's cancel(), and its staged folders are removed.

    Raises Cancelled if it was ended. Results are to be written or collected
    inside, since the folders that they are read from go at the end.
    """
    handle = Job(spark, seconds)
    spark.sparkContext.addJobTag(handle.tag)
    watch = threading.Thread(target=handle._watch, daemon=True)
    try:
        with session.staged_folders() as folders:
            watch.start()
            try:
                yield handle
            except Exception as e:
                if handle.reason:
                    raise Cancelled(handle.reason) from e
                raise
            finally:
                handle._over.set()
                handle._changed.set()
                watch.join()
                spark.sparkContext.removeJobTag(handle.tag)
                session.remove(spark, folders)
    finally:
        handle._over.set()
