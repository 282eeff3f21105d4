"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a min per node and a join back, so no neighbour list is ever gathered, and each round's edges are written
to the shared folder. Rounds grow with the logarithm of the longest path. Nodes with very many edges don't gather them in
one task: see `lookup`. Once a graph has few edges, a round is a few tasks: with tasks by the session's number of shuffle
partitions, most of them without a row, the files of its shuffles took more disk than its edges did."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written

#: Tables of up to FEW rows are broadcast (1 MB of two longs), graphs of up to half as many edges are dealt to a task for EACH of them and two more.
FEW, EACH = 65_536, 8_192


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """(edges written to the shared folder, their number and the sum of their hashes, taken while they are written)."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")), "edges")
    return out, (seen.get["n"], seen.get["h"])


def _tasks(df: DataFrame, edges: int) -> DataFrame:
    """df, of a graph with so many edges, in tasks by their number if they are few."""
    return df.coalesce(2 + edges // EACH) if 2 * edges <= FEW else df


def lookup(rows: DataFrame, table: DataFrame, key: str, n: int, most: int | None = None) -> DataFrame:
    """rows with what table (one row a key, `weight` its number of rows) has for their key, else nulls; n: about how many
    rows there are. Keys with over a thousandth of n rows are so few that they are broadcast, and their rows are dealt by
    their other columns (rows equal in all of them stay together); the rest is an ordinary join. A table that has FEW rows
    at most, where that is known, is broadcast and needs no weight."""
    values, rest = [c for c in table.columns if c not in (key, "weight")], [c for c in rows.columns if c != key]
    if most is not None and most <= FEW:
        return rows.join(F.broadcast(table.select(key, *values)), key, "left").select(*rows.columns, *values)
    is_hot = F.col("weight") > max(1000, n // 1000)
    hot = table.where(is_hot).select(key, F.lit(True).alias("hot"), *(F.col(c).alias(f"hot_{c}") for c in values))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*rest), F.lit(4096)) + 1).otherwise(0)
    marked = rows.join(F.broadcast(hot), key, "left").withColumn("salt", salt)
    zero = F.pmod("weight", F.lit(1))  # of a literal, Spark makes a condition, and deals the rows by the key alone
    found = marked.join(table.where(~is_hot).select(key, zero.alias("salt"), *values), [key, "salt"], "left")
    return found.select(*rows.columns, *(F.when(F.col("hot"), F.col(f"hot_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b longs) -> (node, root): root is the smallest node that can be reached; every node of an edge once."""
    e, state = _round(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while n := state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _tasks(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("weight")), n)
        large = _tasks(lookup(both, low, "a", n, 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), n)
        low = _tasks(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("weight")), n)
        small = lookup(large, low, "a", n, 2 * n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before = state
        e, state = _round(_tasks(small, n))
        if before == state:
            break
    roots = _tasks(e.select(F.col("b").alias("node")).distinct(), state[0]).withColumn("root", F.col("node"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
