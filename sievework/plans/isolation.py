"""Run a step for many jobs at once; where it fails, find the jobs that make it fail.

A step must be repeatable: its writes replace what an earlier attempt has left.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")
# What a step may end with because of the rows, files or stores of a job.
FAILURES = (OSError, RuntimeError, PySparkException, Py4JError)
# So many attempts without a single success are a common cause, not some bad jobs.
PATIENCE = 24


def reason(error: BaseException) -> str:
    """First line of an error, or its kind."""
    lines = str(error).strip().splitlines()
    return lines[0] if lines else type(error).__name__


def halves(jobs: DataFrame, key: str) -> tuple[DataFrame, DataFrame] | None:
    """The jobs cut in two by the middle of their hashes; None for a single one.  No ids reach the driver."""
    place = F.xxhash64(key)
    low, high = jobs.agg(F.min(place), F.max(place)).first()
    if low == high:
        return None
    middle = F.lit((low + high) // 2)
    return jobs.where(place <= middle), jobs.where(place > middle)


class Isolation:
    """Outcome of one step over all its jobs: the sets it passed for, and the sets it failed for."""

    def __init__(self, key: str = "job_id"):
        self.key = key
        self.passed: list[tuple[DataFrame, object]] = []
        self.failed: list[tuple[DataFrame, Exception]] = []
        self._attempts = 0

    def run(self, jobs: DataFrame, step: Callable[[DataFrame], T]) -> Isolation:
        """A set that fails is halved until the jobs that fail are alone; the others go on."""
        waiting = [jobs]
        while waiting:  # breadth first, so that a common cause shows early
            some = waiting.pop(0)
            try:
                self.passed.append((some, step(some)))
                continue
            except FAILURES as error:
                failure = error
            self._attempts += 1
            parts = halves(some, self.key) if self.passed or self._attempts < PATIENCE else None
            if parts is None:
                self.failed.append((some, failure))
            else:
                waiting.extend(parts)
        return self


def united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
