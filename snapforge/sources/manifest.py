"""Manifests in a folder that Spark can reach: runs, the shard table of each, and the current pointer.

root/runs/run_id=R/data/     the snapshot's rows, by shard
root/runs/run_id=R/shards/   a row for each shard that has rows
root/runs/run_id=R/manifest  one JSON document, written after both
root/CURRENT                 one JSON document that names a run

A snapshot is published in two steps: its manifest, then the pointer. All files go through Hadoop's
file systems, so a root may be on any store that Spark reads.
"""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from snapforge.errors import ManifestError, PublishError, StateError

FORMAT = 4
#: Manifests that are read at the same time.
READERS = 16
HISTORY_SCHEMA = "run_id string, published_at timestamp, path string, num_shards int, key_encoding string"


@dataclass(frozen=True)
class Manifest:
    run_id: str
    created_at: str
    num_shards: int
    key_column: str
    key_type: str
    key_encoding: str
    sharding: dict
    rows_written: int = 0
    format_version: int = FORMAT
    custom: dict = field(default_factory=dict)
    #: Schemas of data and shards, as JSON: a snapshot without rows has no file to tell them.
    schemas: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        try:
            made = cls(**json.loads(text))
        except (ValueError, TypeError) as error:
            raise ManifestError(f"not a manifest: {error}") from error
        if made.format_version != FORMAT:
            raise ManifestError(f"format {made.format_version}, not {FORMAT}")
        if made.num_shards < 1:
            raise ManifestError("a snapshot has a shard at least")
        return made


class Files:
    """Small files and folders on a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark.sparkContext._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """In one step where the file system renames in one: written beside, then put in place."""
        beside = self.path(f"{name}.{time.time_ns()}.new")
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        overwrite = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri()).rename(self.fs.makeQualified(beside), self.fs.makeQualified(self.path(name)), overwrite)

    def names(self, folder: str) -> list[str]:
        """What is right under a folder, sorted."""
        at = self.path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)

    def try_delete(self, name: str) -> bool:
        """delete, without an error."""
        try:
            return self.delete(name)
        except Exception:  # noqa: BLE001
            return False


class MemoryFiles:
    """The same in memory, for tests and stores that end with the driver."""

    def __init__(self) -> None:
        self.held: dict[str, str] = {}

    def read(self, name: str) -> str | None:
        return self.held.get(name)

    def write(self, name: str, text: str) -> None:
        self.held[name] = text

    def names(self, folder: str) -> list[str]:
        start = f"{folder}/" if folder else ""
        return sorted({x[len(start) :].split("/")[0] for x in self.held if x.startswith(start)})

    def delete(self, name: str) -> bool:
        gone = [x for x in self.held if x == name or x.startswith(f"{name}/")]
        for x in gone:
            del self.held[x]
        return bool(gone)


class ManifestStore:
    def __init__(self, spark: SparkSession, root: str, files: Files | MemoryFiles | None = None):
        self.spark, self.root, self.files = spark, root.rstrip("/"), files or Files(spark, root)

    def folder(self, run_id: str, part: str = "") -> str:
        return f"{self.root}/runs/run_id={run_id}" + (f"/{part}" if part else "")

    def publish(self, manifest: Manifest, tries: int = 3, wait: float = 1.0) -> None:
        """The manifest, then the pointer; the pointer is tried again if it can't be written."""
        try:
            self.files.write(f"runs/run_id={manifest.run_id}/manifest", manifest.to_json())
        except Exception as error:
            raise PublishError(f"the manifest of {manifest.run_id} was not written") from error
        for n in range(tries):
            try:
                self.set_current(manifest.run_id)
                return
            except Exception as error:
                if n + 1 == tries:
                    raise PublishError(f"{manifest.run_id} is written but not current") from error
                time.sleep(wait * 2**n)

    def set_current(self, run_id: str) -> None:
        if self.load(run_id) is None:
            raise StateError(f"no such run: {run_id}")
        self.files.write("CURRENT", json.dumps({"version": 1, "run_id": run_id, "published_at": datetime.now(UTC).isoformat()}))

    def current(self) -> str | None:
        text = self.files.read("CURRENT")
        if text is None:
            return None
        try:
            return json.loads(text)["run_id"]
        except (ValueError, KeyError, TypeError) as error:
            raise ManifestError("the current pointer can't be read") from error

    def load(self, run_id: str) -> Manifest | None:
        text = self.files.read(f"runs/run_id={run_id}/manifest")
        return None if text is None else Manifest.from_json(text)

    def run_ids(self) -> list[str]:
        """Runs that have a folder, published or not."""
        return [x.removeprefix("run_id=") for x in self.files.names("runs") if x.startswith("run_id=")]

    def manifests(self) -> list[Manifest]:
        """Readable manifests, newest first. They are small and read at once, by as many threads as READERS."""

        def readable(run_id: str) -> Manifest | None:
            try:
                return self.load(run_id)
            except ManifestError:
                return None

        with ThreadPoolExecutor(READERS) as pool:
            found = list(pool.map(readable, self.run_ids()))
        return sorted((m for m in found if m), key=lambda m: (m.created_at, m.run_id), reverse=True)

    def history(self) -> DataFrame:
        """(run_id, published_at, path, num_shards, key_encoding) of the manifests, for operators.lifecycle."""
        rows = [(m.run_id, datetime.fromisoformat(m.created_at), self.folder(m.run_id), m.num_shards, m.key_encoding) for m in self.manifests()]
        return self.spark.createDataFrame(rows, HISTORY_SCHEMA)

    def load_latest(self, fallbacks: int = 3) -> Manifest:
        """The current manifest, or if it can't be read one of the newest others."""
        run_id = self.current()
        if run_id is None:
            raise StateError(f"nothing is published in {self.root}")
        try:
            if made := self.load(run_id):
                return made
        except ManifestError:
            pass
        for made in self.manifests()[:fallbacks]:
            if made.run_id != run_id:
                return made
        raise ManifestError(f"no readable manifest in {self.root}")

    def rollback(self, run_id: str | None = None, offset: int | None = None) -> str:
        """Make a run current, by name or by its place in the history."""
        if (run_id is None) == (offset is None):
            raise StateError("give a run or an offset")
        if run_id is None:
            known = self.manifests()
            if not 0 <= offset < len(known):
                raise StateError(f"no run {offset} places back")
            run_id = known[offset].run_id
        self.set_current(run_id)
        return run_id

    def shards(self, run_id: str) -> DataFrame:
        return self._table(run_id, "shards")

    def data(self, run_id: str) -> DataFrame:
        return self._table(run_id, "data")

    def _table(self, run_id: str, part: str) -> DataFrame:
        """A run's table, by the manifest's schema if it is published with one."""
        made = self.load(run_id)
        reader = self.spark.read
        if made and part in made.schemas:
            reader = reader.schema(StructType.fromJson(json.loads(made.schemas[part])))
        return reader.parquet(self.folder(run_id, part))

    def delete_runs(self, run_ids: list[str], dry_run: bool = True) -> list[str]:
        """Delete runs, never the current one. Returns those that are (or would be) deleted."""
        gone = [r for r in run_ids if r != self.current()]
        return gone if dry_run else [r for r in gone if self.files.delete(f"runs/run_id={r}")]

    def clean(self, older_than: datetime | None = None, keep_last: int | None = None, unpublished: bool = False, dry_run: bool = True) -> list[str]:
        """Delete runs that no criterion spares: see operators.lifecycle.protected_runs; runs without a manifest only if asked for."""
        known = self.manifests()
        spared = {m.run_id for m in known}
        if older_than is not None:
            spared &= {m.run_id for m in known if datetime.fromisoformat(m.created_at) >= older_than}
        if keep_last is not None:
            spared &= {m.run_id for m in known[:keep_last]}
        there = self.run_ids() if unpublished else [m.run_id for m in known]
        return self.delete_runs([r for r in there if r not in spared], dry_run)
