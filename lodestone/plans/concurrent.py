"""Spark jobs of several callers at a time, each under a tag of its own and a time limit."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

#: Used if the session schedules fairly (`spark.scheduler.mode`), so that a long statement does not hold up short ones.
POOL = "statements"
#: How often a caller's jobs are looked at, and cancelled when its time is over.
TICK_SECONDS = 0.25

T = TypeVar("T")
R = TypeVar("R")


class TimedOut(Exception):
    """The time limit passed."""


def _waits(spark: SparkSession, tag: str) -> bool:
    """Whether jobs of the tag run and none of their tasks does: others hold all cores."""
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    infos = [tracker.getJobInfo(job) for job in tracker.getJobIdsForTag(tag)]
    running = [i.get() for i in infos if i.isDefined() and i.get().status().name() == "RUNNING"]
    stages = [tracker.getStageInfo(stage) for info in running for stage in info.stageIds()]
    return bool(running) and not any(s.isDefined() and s.get().numActiveTasks() for s in stages)


def within(spark: SparkSession, seconds: float | None, work: Callable[[], R]) -> R:
    """Runs `work` in this thread; after `seconds` its Spark jobs are cancelled, all that it starts then too.

    Time for which its tasks wait for cores that others hold does not count.
    """
    if seconds is None:
        return work()
    context = spark.sparkContext
    tag, done, late = f"limit-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        spent, last = 0.0, time.monotonic()
        while not done.wait(TICK_SECONDS):
            now = time.monotonic()
            spent, last = spent + (0.0 if _waits(spark, tag) else now - last), now
            if spent >= seconds:
                late.set()
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=inheritable_thread_target(spark)(watch), daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        return work()
    except Exception as error:
        if late.is_set():
            raise TimedOut(f"stopped after {seconds:g} s") from error
        raise
    finally:
        done.set()
        context.removeJobTag(tag)
        watcher.join()


def run_all(spark: SparkSession, work: Callable[[T], R], items: Iterator[T], parallel: int) -> Iterator[R]:
    """`work` of every item, `parallel` at a time, as they end; items are fetched as there is room for them."""

    def pooled(item: T) -> R:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", POOL)
        return work(item)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        running: set[Future] = set()
        for item in items:
            running.add(pool.submit(inheritable_thread_target(spark)(pooled), item))
            if len(running) >= 2 * parallel:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                yield from (f.result() for f in done)
        yield from (f.result() for f in running)
