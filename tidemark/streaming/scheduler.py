"""Runs due downsampling policies: none twice at once, a few at a time."""

from __future__ import annotations

import threading
from concurrent.futures import Future, ThreadPoolExecutor

from .downsample import Downsampler


class Scheduler:
    """``tick`` starts what is due; ``start`` ticks in the background until ``stop``.

    Runs go side by side; the store's own lock orders their entries in its catalog.
    """

    def __init__(self, downsampler: Downsampler, *, concurrency: int = 2, interval: float = 0.1):
        self._d, self._interval = downsampler, interval
        self._pool = ThreadPoolExecutor(concurrency, "downsample")
        self._running: dict[str, Future] = {}
        self._lock, self._stop = threading.Lock(), threading.Event()
        self._thread: threading.Thread | None = None

    def tick(self, now: int | None = None) -> list[str]:
        now = self._d.clock() if now is None else now
        with self._lock:
            self._running = {n: f for n, f in self._running.items() if not f.done()}
            started = [n for n in self._d.due(now) if n not in self._running]
            for n in started:
                self._running[n] = self._pool.submit(self._run, n, now)
        return started

    def _run(self, name: str, now: int) -> None:
        self._d.run(name, now)

    def wait(self) -> None:
        """Until the runs started so far have ended; an error of theirs is in the policy's status."""
        for f in list(self._running.values()):
            f.exception()

    def start(self) -> None:
        def loop() -> None:
            while not self._stop.wait(self._interval):
                self.tick()

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread:
            self._thread.join()
        self._pool.shutdown()
