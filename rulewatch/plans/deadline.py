"""Work items that run side by side, each with a limit of time.

An item that goes beyond its limit has its Spark jobs cancelled by their tag and becomes an error, while the
others go on.  Driver code cannot be ended from outside: an item that is stuck in it is left behind in a
thread of its own, its place is given to the next item, and what it does later has no effect, because it
must pass ``Attempt.begin_writing`` first.  An item that writes already is waited for: its jobs are cancelled
until it ends.
"""

from __future__ import annotations

import queue
import threading
import time
import traceback
import uuid
from collections import deque
from collections.abc import Callable, Iterable

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

PATIENCE = 5.0  # seconds that a cancelled item has to end by itself
LOOK = 0.2  # seconds between looks at the clock


class OverLimit(Exception):
    """The item was cancelled."""


class Attempt:
    def __init__(self):
        self.tag = f"rulewatch-{uuid.uuid4().hex}"
        self.started = time.monotonic()
        self.cancelled = self.writing = False
        self._lock = threading.Lock()

    def begin_writing(self) -> None:
        """From here on the item is not left behind; raises if it is over its limit already."""
        with self._lock:
            if self.cancelled:
                raise OverLimit("cancelled before it wrote anything")
            self.writing = True

    def cancel(self) -> None:
        with self._lock:
            self.cancelled = True


def run_all(
    spark: SparkSession, items: Iterable, body: Callable, workers: int = 4,
    limit: Callable[[object], float | None] = lambda item: None, patience: float = PATIENCE,
) -> list[tuple]:
    """``(item, value, error, seconds)`` of ``body(item, attempt)`` for each item, in their order.

    ``limit`` says how many seconds an item has.
    """
    context, waiting = spark.sparkContext, deque(enumerate(items))
    ended: queue.Queue = queue.Queue()
    running: dict[int, tuple] = {}
    outcomes: dict[int, tuple] = {}

    def start(index, item):
        attempt = Attempt()

        def work():
            value = error = None
            try:
                context.addJobTag(attempt.tag)
                context.setLocalProperty("spark.job.interruptOnCancel", "true")
                value = body(item, attempt)
            except Exception:
                error = traceback.format_exc()
            ended.put((index, value, error))

        running[index] = item, attempt
        threading.Thread(target=inheritable_thread_target(spark)(work), daemon=True).start()

    def finish(index, value, error):
        item, attempt = running.pop(index)
        seconds = time.monotonic() - attempt.started
        if error is not None and attempt.cancelled:
            error = f"over its limit of {limit(item):g} seconds\n{error}"
        outcomes[index] = item, value, error, seconds

    while waiting or running:
        while waiting and len(running) < workers:
            start(*waiting.popleft())
        try:
            index, value, error = ended.get(timeout=LOOK)
            if index in running:  # else it was left behind
                finish(index, value, error)
        except queue.Empty:
            pass
        for index, (item, attempt) in list(running.items()):
            spent, most = time.monotonic() - attempt.started, limit(item)
            if most is not None and spent > most:
                attempt.cancel()
                context.cancelJobsWithTag(attempt.tag)
                if spent > most + patience and not attempt.writing:
                    finish(index, None, "it did not end when it was cancelled")
    return [outcomes[i] for i in sorted(outcomes)]
