"""Ranking: the best row of a group, the last ones, interleaving, top-k. Every order ends in a unique key and spells its
nulls. A rank over everything is only taken after a limit, so no window gathers a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK = "__rank"


def ranked(df: DataFrame, by: list[Column | str], order: list[Column], name: str = RANK) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def keep_best(df: DataFrame, by: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each group. Spark cuts groups to one row in each task before it shuffles them."""
    return ranked(df, by, order).where(F.col(RANK) == 1).drop(RANK)


def mark_duplicates(df: DataFrame, by: list[Column | str], order: list[Column], reason: str = "duplicate", archived: str = "archived", reason_col: str = "archive_reason", key: str | None = None) -> DataFrame:
    """All rows; all but the best of each group are archived with a reason. Where rows have a unique key, groups are cut to
    their best row in each task and its key is joined back, so that a large group is never gathered; without one, each group
    is ranked in one task."""
    if key is None:
        rest = F.col(RANK) > 1
        return ranked(df, by, order).withColumns({archived: rest, reason_col: F.when(rest, reason)}).drop(RANK)
    best = keep_best(df, by, order).select(key, F.lit(True).alias("__best"))
    rest = F.col("__best").isNull()
    return df.join(best, key, "left").withColumns({archived: rest, reason_col: F.when(rest, reason)}).drop("__best")


def first_n(df: DataFrame, by: list[Column | str], order: list[Column], n: int, name: str | None = None) -> DataFrame:
    out = ranked(df, by, order).where(F.col(RANK) <= n)
    return out.withColumnRenamed(RANK, name) if name else out.drop(RANK)


def recent_distinct(df: DataFrame, key: list[str], seen: str, n: int) -> DataFrame:
    """The n keys seen last, newest first: seeing one again moves it to the front."""
    return df.groupBy(*key).agg(F.max(seen).alias(seen)).orderBy(F.desc_nulls_last(seen), *key).limit(n)


def round_robin(df: DataFrame, by: str, order: list[Column], budget: int) -> DataFrame:
    """Rows of all groups in turn, until the budget is spent: every group's first, then every group's second."""
    return first_n(df, [by], order, budget, "turn").orderBy("turn", F.asc_nulls_last(by)).limit(budget)


def top_k(df: DataFrame, order: list[Column], k: int, name: str | None = None) -> DataFrame:
    """The first k rows (at least one), numbered if asked. The rank is taken over k rows only."""
    top = df.orderBy(*order).limit(max(k, 1))
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order))) if name else top


def soonest_then_nearest(minutes: str, metres: str, key: str) -> list[Column]:
    return [F.asc_nulls_last(minutes), F.asc_nulls_last(metres), F.asc(key)]


def by_fixed_order(c: Column, values: list[str]) -> Column:
    """Position in a list; unknown values come last."""
    at = F.coalesce(F.array_position(F.array(*(F.lit(v) for v in values)), c), F.lit(0))
    return F.when(at == 0, 99).otherwise(at)


def page(df: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def page_with_total(df: DataFrame, order: list[Column], number: int, size: int = 20) -> DataFrame:
    """A page, each row with how many rows there are on all pages together."""
    return page(df, order, number, size).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))
