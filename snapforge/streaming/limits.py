"""Admission by token buckets. A bucket holds one second of its rate; larger requests are let through in parts."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from snapforge.errors import ConfigError


class TokenBucket:
    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0:
            raise ConfigError("a rate is positive")
        self.rate, self.held, self.clock, self.sleep = rate, rate, clock, sleep
        self.at, self.lock = clock(), threading.Lock()

    def _fill(self) -> None:
        now = self.clock()
        self.held, self.at = min(self.rate, self.held + (now - self.at) * self.rate), now

    def try_acquire(self, n: float) -> float:
        """0 if n is taken, else the seconds until it could be; n up to the rate."""
        if n > self.rate:
            raise ConfigError(f"{n} is more than a bucket of {self.rate} ever holds")
        with self.lock:
            self._fill()
            if self.held >= n:
                self.held -= n
                return 0.0
            return (n - self.held) / self.rate

    def acquire(self, n: float) -> None:
        """Wait until n is taken, in parts of the rate at most."""
        while n > 0:
            part = min(n, self.rate)
            while wait := self.try_acquire(part):
                self.sleep(wait)
            n -= part
