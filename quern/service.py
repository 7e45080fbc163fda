"""Start-up: the intake of records and the job runner over one store, until they are stopped."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession

from quern.operators.jobs import Runner
from quern.plans import synthesis
from quern.sources.config import Settings
from quern.sources.provider import Provider
from quern.sources.store import Store
from quern.streaming import intake


class Service:
    """Takes records from a folder as they arrive, and works on the jobs that follow.

    Both only change the store by commits, and each commit of one keeps the rows of the
    other; whichever loses a race raises an error and does its batch or step again.
    """

    def __init__(self, spark: SparkSession, base: str, provider: Provider, clock: Callable[[], object], settings: Settings | None = None):
        self.settings = settings or Settings()
        self.spark, self.base, self.clock = spark, base.rstrip("/"), clock
        self.store = Store(spark, f"{self.base}/store")
        self.runner = Runner(self.settings.jobs.concurrency)
        synthesis.register(self.runner, self.store, provider, clock, self.settings.language)
        self._stop, self._thread, self._query = threading.Event(), None, None
        self.failed: BaseException | None = None

    def start(self, every: str = "2 seconds", poll: float = 2.0) -> None:
        """Starts both; a service that runs already stays as it is."""
        if self._thread is not None:
            return
        self._stop.clear()
        folder = f"{self.base}/in"
        intake.drop(self.spark, folder, [])  # the folder has to be there
        self._query = intake.start(self.store, intake.records(self.spark, folder), f"{self.base}/intake", self.clock, skip=self.settings.skip_tools, every=every)
        self._thread = threading.Thread(target=self._work, args=(poll,), daemon=True)
        self._thread.start()

    def _work(self, poll: float) -> None:
        while not self._stop.is_set():
            try:
                synthesis.serve(self.store, self.runner, self.clock, self._stop.is_set, poll, self._stop.wait)
            except OSError as e:  # the intake was first; leases are taken back and the step is done again
                self.failed = e
                self._stop.wait(poll)

    def put(self, records: list[str]) -> None:
        """Drops records (JSON text) for the intake."""
        intake.drop(self.spark, f"{self.base}/in", records)

    def stop(self) -> None:
        """Ends both after what they are at."""
        self._stop.set()
        if self._query is not None:
            self._query.processAllAvailable()
            self._query.stop()
        if self._thread is not None:
            self._thread.join()
        self._thread = self._query = None
