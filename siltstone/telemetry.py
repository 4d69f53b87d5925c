"""Counts and durations of what a process did, as text that a metrics scraper reads. Spark's own metrics are in its UI and event log."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

#: Upper bounds of the durations' buckets, in seconds.
BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 60.0, 300.0)
Labels = tuple[tuple[str, str], ...]


class Metrics:
    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._counts: dict[tuple[str, Labels], float] = {}
        self._durations: dict[tuple[str, Labels], list[float]] = {}

    def count(self, name: str, by: float = 1, **labels: str) -> None:
        key = name, tuple(sorted(labels.items()))
        with self._lock:
            self._counts[key] = self._counts.get(key, 0) + by

    def observe(self, name: str, seconds: float, **labels: str) -> None:
        key = name, tuple(sorted(labels.items()))
        with self._lock:
            own = self._durations.setdefault(key, [0.0] * (len(BUCKETS) + 2))  # the buckets, all, their sum
            for k, most in enumerate(BUCKETS):
                own[k] += seconds <= most
            own[-2] += 1
            own[-1] += seconds

    @contextmanager
    def timed(self, name: str, **labels: str) -> Iterator[None]:
        """The duration, and a count by outcome."""
        began, outcome = time.monotonic(), "error"
        try:
            yield
            outcome = "success"
        finally:
            self.observe(f"{name}_seconds", time.monotonic() - began, **labels)
            self.count(f"{name}_total", outcome=outcome, **labels)

    def value(self, name: str, **labels: str) -> float:
        return self._counts.get((name, tuple(sorted(labels.items()))), 0)

    def text(self) -> str:
        """One line a series, in the text format of metrics scrapers."""

        def line(name: str, labels: Labels, value: float, more: Labels = ()) -> str:
            shown = ",".join('{}="{}"'.format(k, v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")) for k, v in (*labels, *more))
            return f"{name}{{{shown}}} {value:g}" if shown else f"{name} {value:g}"

        out = []
        with self._lock:
            for name in sorted({n for n, _ in self._counts}):
                out.append(f"# TYPE {name} counter")
                out += [line(name, labels, v) for (n, labels), v in sorted(self._counts.items()) if n == name]
            for name in sorted({n for n, _ in self._durations}):
                out.append(f"# TYPE {name} histogram")
                for (n, labels), own in sorted(self._durations.items()):
                    if n == name:
                        out += [line(f"{name}_bucket", labels, v, (("le", f"{most:g}"),)) for most, v in zip(BUCKETS, own)]
                        out += [line(f"{name}_bucket", labels, own[-2], (("le", "+Inf"),)), line(f"{name}_sum", labels, own[-1]), line(f"{name}_count", labels, own[-2])]
        return "\n".join(out) + "\n"


#: What this process did.
METRICS = Metrics()
