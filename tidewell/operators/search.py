"""Search: weighted text relevance, vectors, fused ranks and fuzzy names.

Text relevance is BM25-like over a token table with field weights; it is not the ranking of any database. Vectors are
compared exactly. Each lane keeps its first k rows before ranks are fused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trigram_similarity
from .rank import top_k

#: Weights of the fields of a listing.
WEIGHTS = {"title": 1.0, "venue": 1.0, "neighborhood": 0.4, "kind": 0.4, "quote": 0.2, "mood_tags": 0.1}
RRF_K = 60


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]+", " "), " "), lambda t: t != "")


def text_rank(df: DataFrame, key: str, fields: list[tuple[Column, float]], query: str, k: int) -> DataFrame:
    """(key, score, rank) of the k best rows that hold every query word: the sum over words of idf times weighted tf,
    tf / (tf + 1). Only the query's words are counted, so documents are neither split nor exploded."""
    words = sorted(set("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()))
    count = lambda i, w: F.regexp_count(F.col(f"t{i}"), F.lit(f"(?<![a-z0-9]){w}(?![a-z0-9])"))
    rows = df.select(key, *(F.lower(F.coalesce(c.cast("string"), F.lit(""))).alias(f"t{i}") for i, (c, _) in enumerate(fields)))
    rows = rows.select(key, *(sum((count(i, w) * F.lit(weight) for i, (_, weight) in enumerate(fields)), F.lit(0.0)).alias(f"tf{j}") for j, w in enumerate(words)))
    stats = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(f"tf{j}") > 0).alias(f"df{j}") for j in range(len(words))))
    idf = lambda j: F.log(1 + (F.col("n") - F.col(f"df{j}") + 0.5) / (F.col(f"df{j}") + 0.5))
    every = F.lit(bool(words))
    for j in range(len(words)):
        every = every & (F.col(f"tf{j}") > 0)
    score = sum((idf(j) * F.col(f"tf{j}") / (F.col(f"tf{j}") + 1) for j in range(len(words))), F.lit(0.0))
    scored = rows.where(every).join(F.broadcast(stats)).select(key, F.round(score, 6).alias("score"))
    return top_k(scored, [F.desc("score"), F.asc(key)], k, "rank")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def nearest_vectors(df: DataFrame, key: str, vector: str, query: Column, k: int) -> DataFrame:
    """(key, distance, rank) of the k nearest by cosine distance."""
    return top_k(df.select(key, F.round(1 - cosine(F.col(vector), query), 6).alias("distance")), [F.asc_nulls_last("distance"), F.asc(key)], k, "rank")


def fuse(first: DataFrame, second: DataFrame, key: str, limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    part = lambda r: F.coalesce(1 / (F.lit(k) + F.col(r)), F.lit(0.0))
    both = first.select(key, F.col("rank").alias("r1")).join(second.select(key, F.col("rank").alias("r2")), key, "full_outer")
    return top_k(both.select(key, "r1", "r2", F.round(part("r1") + part("r2"), 8).alias("score")), [F.desc("score"), F.asc(key)], limit)


def fuzzy_places(df: DataFrame, key: str, name: str, category: str, kind: str, confidence: str, query: str, kinds: list[str], limit: int, least: float = 0.3) -> DataFrame:
    """Places by likeness of name or category, with more for a wanted kind and for confidence."""
    q = F.lit(query)
    rows = df.withColumns({"__n": trigram_similarity(F.col(name), q), "__c": trigram_similarity(F.col(category), q)})
    hit = F.coalesce(F.col(kind).isin(kinds), F.lit(False)) if kinds else F.lit(False)
    score = F.greatest("__n", "__c") + F.when(hit, 0.35).otherwise(0.0) + 0.1 * F.coalesce(F.col(confidence), F.lit(0.0))
    found = rows.where((F.col("__n") >= least) | (F.col("__c") >= least) | hit).withColumn("score", F.round(score, 6)).drop("__n", "__c")
    return top_k(found, [F.desc("score"), F.desc_nulls_last(confidence), F.asc(key)], limit)
