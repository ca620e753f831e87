"""Run records: what builds ran, and how they ended. Each change is one small JSON file that replaces the last."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapforge.sources.manifest import Files

SCHEMA = "run_id string, status string, started_at string, ended_at string, error string, heartbeat_at string, lease_until string"


class RunRegistry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def put(self, run_id: str, **fields: str | None) -> None:
        """Add to a run's record. A registry that can't be written must not fail the build, so errors end here."""
        try:
            self.files.write(f"records/{run_id}.json", json.dumps((self.load(run_id) or {"run_id": run_id}) | fields))
        except Exception:  # noqa: BLE001
            return

    def load(self, run_id: str) -> dict | None:
        text = self.files.read(f"records/{run_id}.json")
        return None if text is None else json.loads(text)

    @contextmanager
    def running(self, run_id: str, heartbeat: float = 60.0) -> Iterator[None]:
        """running on entry, then succeeded, or failed with the error. While it runs, each heartbeat renews a lease of three."""
        ended = threading.Event()

        def renew() -> None:
            while not ended.wait(heartbeat):
                self.put(run_id, **self._lease(heartbeat))

        self.put(run_id, status="running", started_at=datetime.now(UTC).isoformat(), **self._lease(heartbeat))
        beats = threading.Thread(target=renew, daemon=True)
        beats.start()
        outcome: dict[str, str | None] = {"status": "succeeded"}
        try:
            yield
        except BaseException as error:
            outcome = {"status": "failed", "error": str(error)[:1000]}
            raise
        finally:
            ended.set()
            beats.join()
            self.put(run_id, ended_at=datetime.now(UTC).isoformat(), **outcome)

    @staticmethod
    def _lease(heartbeat: float) -> dict[str, str]:
        now = datetime.now(UTC)
        return {"heartbeat_at": now.isoformat(), "lease_until": (now + timedelta(seconds=3 * heartbeat)).isoformat()}

    def lost(self, at: datetime | None = None) -> DataFrame:
        """Records of runs that say they run, but whose lease is over."""
        return self.records().where((F.col("status") == "running") & (F.to_timestamp("lease_until") < F.lit(at or datetime.now(UTC))))

    def records(self) -> DataFrame:
        names = [x for x in self.files.names("records") if x.endswith(".json")]
        found = [self.load(x.removesuffix(".json")) for x in names]
        return self.spark.createDataFrame([tuple(r.get(f.split()[0]) for f in SCHEMA.split(", ")) for r in found], SCHEMA)
