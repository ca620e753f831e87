"""Events of builds and readers, for a collector that has emit(event, fields)."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

#: Events that are emitted, with what they say.
EVENTS = {
    "write_started": "run_id, num_shards", "shards_written": "run_id, rows_written", "published": "run_id",
    "reader_opened": "run_id", "reader_refreshed": "run_id", "reader_closed": "run_id", "lookup": "keys, seconds", "search": "queries, seconds",
}


class Recorder:
    """Keeps events in memory, with counts and total seconds."""

    def __init__(self) -> None:
        self.events: list[tuple[str, dict]] = []
        self.counts: Counter[str] = Counter()
        self.seconds: Counter[str] = Counter()
        self._lock = threading.Lock()

    def emit(self, event: str, fields: dict) -> None:
        with self._lock:
            self.events.append((event, dict(fields)))
            self.counts[event] += 1
            self.seconds[event] += fields.get("seconds", 0)

    def __call__(self, event: str, fields: dict) -> None:
        self.emit(event, fields)

    @contextmanager
    def timed(self, event: str, **fields: object) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.emit(event, fields | {"seconds": time.perf_counter() - began})
