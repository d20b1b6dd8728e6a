"""Load on a callable, such as a store's search: closed-loop workers and latency figures."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

import numpy as np


def load_percentile(values: list[float], p: float) -> float:
    """The value at index floor(p * (n - 1)) of the sorted values; 0 without any."""
    return float(np.sort(values)[int(p * (len(values) - 1))]) if len(values) else 0.0


def run_load(calls: list[Callable[[], object]], seconds: float, workers: int = 1, warm_up: float = 0.0) -> dict[str, float]:
    """Call the functions in turn from ``workers`` threads for some seconds, each as soon as its last
    call has ended: requests a second, errors, and latencies in seconds. Calls of the warm-up, and
    failed ones, have no latency."""
    lock = threading.Lock()
    took: list[float] = []
    errors = 0
    start = time.perf_counter() + warm_up
    end = start + seconds

    def work(k: int) -> None:
        nonlocal errors
        n = k
        while (began := time.perf_counter()) < end:
            ok = True
            try:
                calls[n % len(calls)]()
            except Exception:
                ok = False
            n += workers
            if began >= start:
                with lock:
                    errors += not ok
                    if ok:
                        took.append(time.perf_counter() - began)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(workers)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    spent = time.perf_counter() - start
    return {"requests": float(len(took)), "errors": float(errors), "per_second": len(took) / spent, **{f"p{int(1000 * p) / 10:g}": load_percentile(took, p) for p in (0.5, 0.95, 0.99, 0.999)}}
