"""Independent Spark jobs submitted from driver threads.

The three detectors (and the scoring write of the detect pipeline) read the
same input but do not depend on each other; submitted from separate driver
threads they run as concurrent Spark jobs, so one job's single-task phases
(small scans, final aggregates, writes) overlap with another's wide stages.
Only job submission is threaded -- no data passes through the driver.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context


def run_concurrently(*thunks):
    """Call every zero-argument function on its own driver thread; return
    their results in order (the first error is raised)."""
    if len(thunks) <= 1:
        return [t() for t in thunks]
    with ThreadPoolExecutor(max_workers=len(thunks), thread_name_prefix="flowlens-job") as pool:
        futures = [pool.submit(copy_context().run, t) for t in thunks]
        return [f.result() for f in futures]


def run_detectors(features, assets=None):
    """``(lateral, exfil, findings)`` of one feature table, computed concurrently."""
    from flowlens.operators.exfil import detect_exfil
    from flowlens.operators.ics import detect_ics
    from flowlens.operators.lateral import detect_lateral
    return run_concurrently(lambda: detect_lateral(features),
                            lambda: detect_exfil(features),
                            lambda: detect_ics(features, assets))
