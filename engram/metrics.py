"""Request counts and latencies of one process, and their text exposition."""

from __future__ import annotations

import threading
import time
from collections import Counter
from contextlib import contextmanager

from engram.operators.stats import LATENCY_ENDS
from engram.schema import EngineError


def _labels(**kw) -> str:
    clean = lambda v: str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return "{" + ",".join(f'{k}="{clean(v)}"' for k, v in kw.items()) + "}"


class Metrics:
    """Counts by (method, path, status); a status is the code of an error, or OK."""

    def __init__(self):
        self._lock, self.counts, self.seconds, self.classes = threading.Lock(), Counter(), Counter(), Counter()

    def record(self, method: str, path: str, status: str, seconds: float) -> None:
        key = (method, path, status)
        with self._lock:
            self.counts[key] += 1
            self.seconds[key] += seconds
            for end in LATENCY_ENDS:
                self.classes[(*key, end)] += seconds <= end

    @contextmanager
    def request(self, method: str, path: str):
        start, status = time.perf_counter(), "OK"
        try:
            yield
        except EngineError as e:
            status = e.code
            raise
        except Exception:
            status = EngineError.code
            raise
        finally:
            self.record(method, path, status, time.perf_counter() - start)

    def text(self, gauges: dict[str, float] | None = None) -> str:
        """The text exposition format: counters, latency histograms, and gauges by name."""
        with self._lock:
            counts, seconds, classes = dict(self.counts), dict(self.seconds), dict(self.classes)
        lines = ["# TYPE engram_requests_total counter"]
        lines += [f"engram_requests_total{_labels(method=m, path=p, status=s)} {n}" for (m, p, s), n in sorted(counts.items())]
        lines.append("# TYPE engram_request_seconds histogram")
        for (m, p, s), n in sorted(counts.items()):
            lines += [f"engram_request_seconds_bucket{_labels(method=m, path=p, status=s, le=f'{e:g}')} {classes[m, p, s, e]}" for e in LATENCY_ENDS]
            lines.append(f"engram_request_seconds_bucket{_labels(method=m, path=p, status=s, le='+Inf')} {n}")
            lines.append(f"engram_request_seconds_sum{_labels(method=m, path=p, status=s)} {seconds[m, p, s]:.6f}")
            lines.append(f"engram_request_seconds_count{_labels(method=m, path=p, status=s)} {n}")
        for k, v in (gauges or {}).items():
            lines += [f"# TYPE engram_{k} gauge", f"engram_{k} {v:g}"]
        return "\n".join(lines) + "\n"
