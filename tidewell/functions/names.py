"""Comparing names: without regard to case, by part, and in a locale's order, by Spark's collations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import like_literal


def holds_term(c: Column, term: str) -> Column:
    """Whether a text holds a term, whatever the case; % and _ stand for themselves."""
    return c.ilike(f"%{like_literal(term)}%")


def same_name(c: Column, term: str) -> Column:
    """Whether a text is a term, whatever the case, but for nothing else: accents count, % and _ stand for themselves."""
    return F.collate(c, "UTF8_LCASE") == F.collate(F.lit(term), "UTF8_LCASE")


def alike_name(a: Column, b: Column) -> Column:
    """Whether two names are the same but for case and accents."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")


def pick_list(df: DataFrame, name: str, key: str, term: str, limit: int, locale: str = "UNICODE") -> DataFrame:
    """The first rows, in a locale's order of names, whose name holds a term."""
    return df.where(holds_term(F.col(name), term)).orderBy(F.asc_nulls_last(F.collate(name, locale)), F.asc(key)).limit(limit)
