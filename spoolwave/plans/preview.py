"""One running preview at a time: the newest request wins."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Hashable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession


class Previews:
    """A slot for one request. A new one interrupts the jobs of the one before (by its tag), and whatever that still returns is
    dropped: only the newest is answered, once, by (key, rows) or (key, error). Rows are those of an envelope, as many as columns are
    shown."""

    def __init__(self, spark: SparkSession, reply: Callable[[Hashable, list[Row] | Exception], None]) -> None:
        self.spark, self.reply = spark, reply
        self.lock = threading.Lock()
        self.tag: str | None = None
        self.threads: list[threading.Thread] = []

    def request(self, key: Hashable, rows: Callable[[], DataFrame]) -> None:
        """Ask for the rows of a DataFrame that `rows` plans; what was asked before is given up."""
        tag = f"preview-{uuid.uuid4().hex}"
        with self.lock:
            before, self.tag = self.tag, tag
        if before:
            self.spark.interruptTag(before)
        self.threads = [t for t in self.threads if t.is_alive()]
        self.threads.append(InheritableThread(target=self._run, args=(tag, key, rows), session=self.spark))
        self.threads[-1].start()

    def _run(self, tag: str, key: Hashable, rows: Callable[[], DataFrame]) -> None:
        self.spark.addTag(tag)
        try:
            answer: list[Row] | Exception = rows().collect() if self._newest(tag) else []
        except Exception as why:  # handed to whoever asked, unless it was interrupted
            answer = why
        finally:
            self.spark.removeTag(tag)
        if self._newest(tag):
            self.reply(key, answer)

    def _newest(self, tag: str) -> bool:
        with self.lock:
            return self.tag == tag

    def close(self) -> None:
        """Give up what runs and wait for it."""
        with self.lock:
            before, self.tag = self.tag, None
        if before:
            self.spark.interruptTag(before)
        for t in self.threads:
            t.join()
