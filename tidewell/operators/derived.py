"""Columns derived at write: search texts, weights and the like are kept beside the columns that they follow from, and
worked out anew only for rows whose inputs have changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Versions

#: The batch in which a row's derived columns were last worked out.
BATCH = "derived_in"


@dataclass
class Derived:
    inputs: list[str]
    value: Column  # of the inputs


def merged(current: DataFrame | None, changes: DataFrame, key: str, derived: dict[str, Derived], batch: int) -> DataFrame:
    """current (with its derived columns and BATCH; None for a new table) with the changed rows: whole rows by key, one a
    key. A derived column is worked out for new rows and where one of its inputs differs (null-safe), else kept."""
    if current is None:
        return changes.select("*", *(d.value.alias(c) for c, d in derived.items()), F.lit(batch).cast("long").alias(BATCH))
    plain = [c for c in current.columns if c not in (key, BATCH) and c not in derived]
    old = current.select(key, F.struct(*plain).alias("__old"), *(F.col(c).alias(f"__old_{c}") for c in (*derived, BATCH)), F.lit(True).alias("__was"))
    both = old.join(changes.select(key, F.struct(*plain).alias("__new"), F.lit(True).alias("__is")), key, "full_outer")
    is_, was = F.coalesce("__is", F.lit(False)), F.coalesce("__was", F.lit(False))
    stale = {}
    for c, d in derived.items():
        differs = ~was
        for i in d.inputs:
            differs = differs | ~F.col(f"__old.{i}").eqNullSafe(F.col(f"__new.{i}"))
        stale[c] = is_ & differs
    rows = both.select(key, *(F.when(is_, F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) for c in plain), *(s.alias(f"__stale_{c}") for c, s in stale.items()), *(f"__old_{c}" for c in (*derived, BATCH)))
    kept = [F.when(F.col(f"__stale_{c}"), d.value).otherwise(F.col(f"__old_{c}")).alias(c) for c, d in derived.items()]
    any_ = F.greatest(*(F.col(f"__stale_{c}") for c in derived), F.lit(False), F.lit(False))
    return rows.select(key, *plain, *kept, F.when(any_, F.lit(batch).cast("long")).otherwise(F.col(f"__old_{BATCH}")).alias(BATCH))


def write_batch(table: Versions, changes: DataFrame, key: str, derived: dict[str, Derived], batch: int) -> DataFrame:
    """The table after a batch; a batch that was written before changes nothing."""
    if not table.has(str(batch)):
        table.write(merged(table.read() if table.latest() else None, changes, key, derived, batch), str(batch))
    return table.read()
