"""Several Spark jobs at a time from the driver, never more than ``slots``.

Fits of folds, settings and models do not depend on each other; one after
another they leave the cluster idle between stages.  Results come in the order
of the tasks, so rows do not depend on the number of slots.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")

#: Jobs at a time where the caller names no number.
SLOTS = 4


def in_parallel(spark: SparkSession, tasks: Sequence[Callable[[], T]], slots: int = SLOTS) -> list[T]:
    """Results of ``tasks`` in their order; the first failure is raised and tasks not yet begun are dropped."""
    if slots <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    with ThreadPoolExecutor(min(slots, len(tasks))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]
        try:
            return [r.result() for r in running]
        except BaseException:
            for r in running:
                r.cancel()
            raise
