"""What a statement may use; a limit that would be passed is an error that names it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from graphloom.errors import LimitExceeded


@dataclass(frozen=True)
class Limits:
    """None is no limit.

    hops bounds variable lengths and path lengths when a statement is planned. rows bounds what a
    statement collects, each arm of a union as well as the whole. edges bounds the relationships of the
    types that a statement names, intermediate the rows that a traversal holds after a hop and the
    choices of parallel relationships that paths are expanded to, seconds the time of a collected
    statement.
    """

    hops: int = 16
    rows: int | None = 100_000
    intermediate: int | None = None
    edges: int | None = None
    seconds: float | None = None

    def check(self, name: str, value: int) -> None:
        most = getattr(self, name)
        if most is not None and value > most:
            raise LimitExceeded(f"{value} {'rows in between' if name == 'intermediate' else name} are over the limit of {most}")

    def check_rows(self, df: DataFrame) -> None:
        """Fails if an intermediate table has more rows than may be; counts nothing without a limit."""
        if self.intermediate is not None:
            self.check("intermediate", df.count())

    def timed[T](self, spark: SparkSession, work: Callable[[], T]) -> T:
        """What work() gives; its jobs are cancelled when the time is over."""
        if self.seconds is None:
            return work()
        tag = f"graphloom-{uuid.uuid4().hex}"
        over = threading.Event()

        def stop() -> None:
            over.set()
            spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(self.seconds, stop)
        spark.sparkContext.addJobTag(tag)
        timer.start()
        try:
            out = work()
        except Exception:
            if over.is_set():
                raise LimitExceeded(f"the statement took more than the limit of {self.seconds} seconds") from None
            raise
        finally:
            timer.cancel()
            spark.sparkContext.removeJobTag(tag)
        if over.is_set():
            raise LimitExceeded(f"the statement took more than the limit of {self.seconds} seconds")
        return out


UNBOUNDED = Limits(rows=None)
