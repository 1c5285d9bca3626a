"""Timings and row counts of stages, with an optional tracer."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, MutableMapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@contextmanager
def stage(name: str, timings: MutableMapping[str, float], tracer: Any = None) -> Iterator[Any]:
    """Time a block in milliseconds. A ``tracer`` (anything with ``start_as_current_span``) gets a span with the stage's
    name, its time, and the type of an error that leaves the block; without one the span is None."""
    began = time.perf_counter()
    if tracer is None:
        try:
            yield None
        finally:
            timings[name] = round((time.perf_counter() - began) * 1000, 4)
        return
    with tracer.start_as_current_span(f"lodeweave.{name}") as span:
        try:
            yield span
        except Exception as error:
            span.set_attribute("error_type", type(error).__name__)
            span.record_exception(error)
            raise
        finally:
            timings[name] = round((time.perf_counter() - began) * 1000, 4)
            span.set_attribute("stage", name)
            span.set_attribute("duration_ms", timings[name])


def counted(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """``df`` with its rows (and further aggregate ``metrics``) counted while it is read; the counts are there after an action."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(seen, F.count("*").alias("rows"), *[c.alias(n) for n, c in metrics.items()]), seen
