"""Running one Spark job per object and keeping a status row for each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from stowage.session import small_frame

STATUS_SCHEMA = "kind string, name string, status string, rows bigint, error string"

OK, FAILED, SKIPPED, UNSUPPORTED, BLOCKED, NOT_RUN = "OK", "FAILED", "SKIPPED", "UNSUPPORTED", "BLOCKED", "NOT_RUN"


@dataclass
class Status:
    kind: str
    name: str
    status: str = OK
    rows: int | None = None
    error: str | None = None

    def as_row(self) -> tuple:
        return (self.kind, self.name, self.status, self.rows, self.error)


class Ledger:
    """Status rows of a run; ``stopped`` is set by a failure unless the run goes on after failures."""

    def __init__(self, continue_on_failure: bool) -> None:
        self.rows: list[Status] = []
        self.continue_on_failure = continue_on_failure

    @property
    def stopped(self) -> bool:
        return not self.continue_on_failure and any(r.status == FAILED for r in self.rows)

    def add(self, status: Status) -> None:
        self.rows.append(status)

    def failed(self) -> list[Status]:
        return [r for r in self.rows if r.status == FAILED]

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = sorted(self.rows, key=lambda r: (r.kind, r.name))
        return small_frame(spark, [r.as_row() for r in rows], STATUS_SCHEMA)


def error_text(error: BaseException) -> str:
    """All of an error's message, without the stack of the JVM."""
    return f"{type(error).__name__}: {str(error).partition('JVM stacktrace:')[0].strip()}"


def run_all(spark: SparkSession, ledger: Ledger, items: Sequence[tuple[str, str, Callable[[], int | None]]],
            concurrency: int) -> None:
    """Run ``(kind, name, job)`` items on up to ``concurrency`` driver threads.

    The threads only submit Spark jobs; after a failure nothing new starts unless the run goes on.
    """

    def attempt(kind: str, name: str, job: Callable[[], int | None]) -> Status:
        if ledger.stopped:
            return Status(kind, name, NOT_RUN)
        try:
            return Status(kind, name, OK, job())
        except Exception as error:  # noqa: BLE001 - every failure becomes a status row
            return Status(kind, name, FAILED, None, error_text(error))

    with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(attempt), *item) for item in items]
        for future in as_completed(futures):
            ledger.add(future.result())
