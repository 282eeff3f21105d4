"""Sinks as rewrites: plain Parquet tables know no MERGE, so the new state is computed and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, one row with counts inserted and skipped). Of new rows with one key the first by order counts."""
    from .rank import keep_best

    fresh = keep_best(new, keys, order).join(target.select(*keys), keys, "left_anti")
    inserted = fresh.agg(F.count("*").alias("inserted"))
    return fresh, new.agg(F.count("*").alias("n")).join(F.broadcast(inserted)).select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], present: dict[str, Column] | None = None, only: list[str] | None = None) -> DataFrame:
    """base with changes merged by key. A changed column overwrites, explicit nulls too, where it is present; `present`
    maps columns to conditions over changes (all columns of changes are present by default), `only` limits them."""
    cols = [c for c in changes.columns if c not in keys and (only is None or c in only)]
    marked = changes.select(*keys, *(F.struct((present or {}).get(c, F.lit(True)).alias("there"), F.col(c).alias("value")).alias(f"__new_{c}") for c in cols), F.lit(True).alias("__changed"))
    both = base.withColumn("__base", F.lit(True)).join(marked, keys, "full_outer")

    def value(c: str) -> Column:
        if c not in cols:
            return F.col(c)
        new = F.col(f"__new_{c}")
        return F.when(F.col("__changed") & new["there"], new["value"]).otherwise(F.col(c)).alias(c)

    return both.select(*keys, *(value(c) for c in base.columns if c not in keys))


def update_from(base: DataFrame, other: DataFrame, keys: list[str], values: dict[str, str], when: Column | None = None) -> DataFrame:
    """UPDATE ... FROM: columns of base from columns of other (one row a key) where a row matches and `when` holds."""
    found = other.select(*keys, *(F.col(v).alias(f"__from_{c}") for c, v in values.items()), F.lit(True).alias("__found"))
    take = F.coalesce(F.col("__found"), F.lit(False)) & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
    return base.join(found, keys, "left").select(*(F.when(take, F.col(f"__from_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in base.columns))


def update_where(df: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... WHERE: null conditions don't hold. All values see the row as it was."""
    return df.select(*(F.when(F.coalesce(when, F.lit(False)), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns), *(F.when(F.coalesce(when, F.lit(False)), v).alias(c) for c, v in values.items() if c not in df.columns))


def soft_archive(df: DataFrame, when: Column, now: Column, reason: str) -> DataFrame:
    return update_where(df, when, {"archived_at": now, "archive_reason": F.lit(reason)})


def purge(df: DataFrame, stamp: str, before: Column) -> DataFrame:
    """Rows not older than a limit; those without a stamp stay."""
    return df.where(F.col(stamp).isNull() | (F.col(stamp) >= before))


def exclusive_flag(df: DataFrame, key: str, chosen: Column, flag: str) -> DataFrame:
    """One row holds the flag: the chosen one."""
    return df.withColumn(flag, F.coalesce(F.col(key) == chosen, F.lit(False)))


def hand_over(df: DataFrame, chosen: DataFrame, group: str, key: str, flag: str) -> DataFrame:
    """chosen (group, key): the rows that take the flag. In their groups nobody else keeps it; other groups stay as they
    are, and so do groups whose chosen row is not there. Of several chosen of a group the first by key counts."""
    one = chosen.groupBy(group).agg(F.min(key).alias("__chosen"))
    there = df.join(one, group).where(F.col(key) == F.col("__chosen")).select(group, "__chosen").distinct()
    marked = df.join(there, group, "left")
    held = F.when(F.col("__chosen").isNull(), F.col(flag)).otherwise(F.col(key) == F.col("__chosen"))
    return marked.select(*(held.alias(c) if c == flag else F.col(c) for c in df.columns))


def reset_flag(df: DataFrame, flag: str, unless: str, within: Column | None = None) -> DataFrame:
    """The flag taken from all rows within a scope, but for those known or thought to hold another: null there is no no."""
    when = F.col(flag) & ~F.col(unless)
    return update_where(df, when if within is None else when & within, {flag: F.lit(False)})


def merge_filled(base: DataFrame, forms: DataFrame, keys: list[str], always: list[str] | None = None) -> DataFrame:
    """base with forms merged by key (one form a key): filled fields overwrite, blank texts and nulls leave what is there;
    those of `always` overwrite whatever they hold. Forms without a row make one."""
    from ..functions.text import or_null

    kinds = dict(forms.dtypes)
    clean = forms.select(*(or_null(F.col(c)).alias(c) if kinds[c] == "string" and c not in keys else F.col(c) for c in forms.columns))
    filled = {c: F.lit(True) if c in (always or []) else F.col(c).isNotNull() for c in forms.columns if c not in keys}
    return upsert(base, clean, keys, filled)


def delete_with_parts(wholes: DataFrame, parts: DataFrame, gone: DataFrame, key: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """(wholes, parts) without those whose key is in gone (key): what a part points to stays where it is."""
    keys = gone.select(key).distinct()
    return wholes.join(keys, key, "left_anti"), parts.join(keys.withColumnRenamed(key, ref), ref, "left_anti").select(*parts.columns)


def get_or_create(target: DataFrame, wanted: DataFrame, city: str, name: str) -> DataFrame:
    """target with the wanted (city, name) rows that it lacks; names are equal without regard to case."""
    key = lambda df: df.withColumns({"__city": F.col(city), "__name": F.lower(F.trim(F.col(name)))})
    from .rank import keep_best

    missing = keep_best(key(wanted), ["__city", "__name"], [F.asc_nulls_last(name)]).join(key(target).select("__city", "__name"), ["__city", "__name"], "left_anti").drop("__city", "__name")
    return target.unionByName(missing, allowMissingColumns=True)


def change_journal(old: DataFrame, new: DataFrame, key: str, cols: list[str], changed_at: Column) -> DataFrame:
    """A row for each key in both whose columns differ (null-safe): key, old_*, new_*, changed_at."""
    o, n = (df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in cols)) for df, p in ((old, "old"), (new, "new")))
    differs = F.lit(False)
    for c in cols:
        differs = differs | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    return o.join(n, key).where(differs).withColumn("changed_at", changed_at)


def run_log(fn: str, status: str, counts: DataFrame, finished_at: Column) -> DataFrame:
    """One log row with its counts as JSON."""
    return counts.select(F.lit(fn).alias("fn"), F.lit(status).alias("status"), F.to_json(F.struct(*counts.columns)).alias("detail"), finished_at.alias("finished_at"))
