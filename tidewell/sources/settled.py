"""Several sources, each read within a deadline and settled for itself: one that fails or is late is replaced by its
snapshot, and the others are not touched."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Source:
    live: Callable[[], DataFrame]  # may take long or fail
    snapshot: Callable[[], DataFrame]


def settled(spark: SparkSession, sources: dict[str, Source], folder: str, seconds: float = 2.0) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the sources' tables, one row a source: source, fell_back, reason). Each live source is written to the folder in a job
    of its own; one that isn't there by its deadline is cancelled and its snapshot taken. What a source gives is thus read
    once, and a source that would fail later has failed by then."""
    run, done = uuid.uuid4().hex, {}

    def land(name: str, source: Source) -> None:
        path = f"{folder}/{run}/{name}"
        try:
            spark.addTag(f"{run}-{name}")
            source.live().write.parquet(path)
            done[name] = (spark.read.parquet(path), None)
        except Exception as e:  # noqa: BLE001  whatever it is, the snapshot stands in and the reason is told
            done[name] = (None, type(e).__name__)

    threads = {name: threading.Thread(target=land, args=(name, s), daemon=True) for name, s in sources.items()}
    for t in threads.values():
        t.start()
    from time import monotonic

    until = monotonic() + seconds
    tables, rows = {}, []
    for name, thread in threads.items():
        thread.join(max(0.0, until - monotonic()))
        table, reason = done.get(name, (None, "late"))
        if name not in done:
            spark.interruptTag(f"{run}-{name}")
        tables[name] = sources[name].snapshot() if table is None else table
        rows.append((name, table is None, reason))
    return tables, spark.createDataFrame(rows, "source string, fell_back boolean, reason string")
