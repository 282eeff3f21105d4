"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's word
shingles, repeats included. Fingerprints link when at most `radius` bits differ; linked ones share a component.

Search: a fingerprint is cut into segments, each with a hash table of its values. Two linked fingerprints are close in
some segment (pigeonhole), so enumerating a small Hamming ball around each segment's value and fetching the table's
matches meets every link; complete distances are verified in the join's condition. How many segments there are follows
from the number of fingerprints (few long segments for many fingerprints): it changes cost only, never results.

Groups of copies: equal fingerprints are one row from the start. Before the search, neighbours in each table's sorted
order are linked in chains and their components found; the search then keeps links between different components only.
Chains are read off ranges of the sorted tables, so a common value of a segment is no task of its own; where a range
ends a chain ends, and the search finds that link.
So a large group of near copies does not put out its pairs, and no link that matters is lost. However many near copies a
text has, under 700,000 fingerprints lie within 4 bits of its own, so they don't fill a table's key beyond that.

Cases: null counts as empty; a text without words has fingerprint zero and is linked like any other; with fewer words
than a shingle, the whole sequence is the shingle. Rows with null ids get components too, but name one only if no other
row of it has an id. Repeated rows and ties get equal answers. An empty table gives an empty result. Other columns are
ignored by `fingerprints` and `near_duplicates` and kept by `keep_one`, even those named like ours."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, col, id_name, written
from .components import components, lookup

FP = OWN + "fp"
SHINGLE, RADIUS, SEED = 4, 4, 42


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # splits at \x20 and \x09-\x0D, lowers A-Z
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends]
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 65536):
        to = min(n, at + 65536)
        h = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts[at:to], ends[at + k - 1 : to + k - 1], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of the hashes of a text's shingles, as `simhash` takes it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs and its fingerprint FP, as a signed long."""
    names = docs.columns
    at = names.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(x, shingle, seed) for x in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*names, FP])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(FP, T.LongType())]))


def segments(n: int, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment, for n fingerprints: the cheapest number of segments up to the radius
    (with more of them no ball would hold more than its centre), by the rows that probe and the rows expected to match.
    If q * m + r is the radius, the first r + 1 of m segments are searched to radius q and the rest to q - 1: were all
    beyond, the distances would add up to more than the radius."""
    from math import comb

    def plan(m: int) -> list[tuple[int, int, int]]:
        widths = [64 // m + (i < 64 % m) for i in range(m)]
        q, r = divmod(radius, m)
        return [(sum(widths[:i]), w, q if i <= r else q - 1) for i, w in enumerate(widths) if i <= r or q > 0]

    def cost(p: list[tuple[int, int, int]]) -> float:
        return sum(sum(comb(w, k) for k in range(r + 1)) * (n + n * n / 2.0**w / 8) for _, w, r in p)

    return min((plan(m) for m in range(2, max(3, radius + 1))), key=cost)


def ball(width: int, radius: int) -> list[int]:
    """All masks of at most radius bits within width."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ 1 << b for m in masks for b in range(width)}
    return sorted(masks)


def _keys(segs: list[tuple[int, int, int]], balls: bool) -> Column:
    """Table keys of FP: segment number and value; with balls, those of all probes."""
    def keys(i: int, first: int, width: int, radius: int) -> Column:
        value = F.shiftrightunsigned(F.col(FP), first).bitwiseAND(F.lit((1 << width) - 1))
        masks = F.array(*(F.lit(m).cast("long") for m in (ball(width, radius) if balls else [0])))
        return F.transform(masks, lambda m: value.bitwiseXOR(m) * F.lit(8) + F.lit(i))

    return F.explode(F.concat(*(keys(i, *s) for i, s in enumerate(segs))))


def _chains(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b): each fingerprint of a table with the first one of its chain, over (key, FP) in sorted ranges."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, start = None, np.int64(0), np.int64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.ones(len(fps), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (np.bitwise_count((fps[1:] ^ fps[:-1]).view(np.uint64)) > radius)
            new[0] = key is None or keys[0] != key or np.bitwise_count((fps[:1] ^ fp).view(np.uint64))[0] > radius
            at = np.maximum.accumulate(np.where(new, np.arange(len(fps)), -1))
            starts = np.where(at < 0, start, fps[np.maximum(at, 0)])
            key, fp, start = keys[-1], fps[-1], starts[-1]
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(starts)], ["a", "b"])

    return keyed.repartitionByRange("key", FP).sortWithinPartitions("key", FP).select("key", FP).mapInArrow(read, "a long, b long")


def link_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps: distinct FP, written. -> (FP, root): the smallest fingerprint reachable, for every fingerprint."""
    n = fps.count()
    segs = segments(n, radius)
    apart = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    first = components(_chains(fps.select(_keys(segs, balls=False).alias("key"), FP), radius))
    named = written(fps.join(first.withColumnRenamed("node", FP), FP, "left").select(FP, F.coalesce("root", FP).alias("c")), "chained")
    table = named.select(F.col(FP).alias("t_fp"), F.col("c").alias("t_c"), _keys(segs, balls=False).alias("key"))
    probes = named.select(FP, "c", _keys(segs, balls=True).alias("key"))
    links = probes.join(table, (probes["key"] == table["key"]) & (F.col("c") < F.col("t_c")) & (apart(F.col(FP), F.col("t_fp")) <= radius))
    merged = components(links.select(F.col("c").alias("a"), F.col("t_c").alias("b")))
    sizes = named.groupBy("c").agg(F.count("*").alias("weight")).join(merged.withColumnRenamed("node", "c"), "c")
    return lookup(named, sizes, "c", n).select(FP, F.coalesce("root", "c").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row a document: id, fingerprint (16 hex digits), component_id (smallest id in its component)."""
    narrow = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    prints = written(fingerprints(narrow, "text", shingle).select("id", FP), "fingerprints")
    roots, n = _roots(prints, "id", radius)
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("weight"))
    named = written(lookup(roots.select(FP, "rows", "root"), least, "root", n).select(FP, "component_id", F.col("rows").alias("weight")), "components")
    out = lookup(prints, named, FP, n)
    return out.select(F.col("id").alias(id_name(id_col, ["fingerprint", "component_id"])), F.lpad(F.lower(F.hex(FP)), 16, "0").alias("fingerprint"), "component_id")


def _roots(prints: DataFrame, id_col: str, radius: int) -> tuple[DataFrame, int]:
    """((FP, id, rows, root) for every fingerprint of prints, where id is the smallest that has it; how many rows prints has)."""
    fps = written(prints.groupBy(FP).agg(F.min(id_col).alias("id"), F.count("*").alias("rows")), "distinct")
    roots = written(link_components(fps.select(FP), radius), "roots")
    return fps.join(roots, FP), fps.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without near copies: of each component the document with the smallest id stays (rows without one come last;
    among rows with that id, the smallest fingerprint and then the smallest text)."""
    prints = written(fingerprints(docs.select(id_col, text_col), text_col, shingle).select(id_col, FP), "fingerprints")
    first = _roots(prints, id_col, radius)[0].groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", FP)).alias("s"))
    stay = written(first.select(F.col(f"s.{FP}").alias(FP), F.coalesce(F.col("s.id").cast("string"), F.lit("")).alias(OWN + "k")), "representatives")
    full = fingerprints(docs, text_col, shingle).withColumn(OWN + "k", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    kept = full.join(stay, [FP, OWN + "k"], "left_semi")
    w = Window.partitionBy(FP, OWN + "k").orderBy(text_col)
    return kept.withColumn(OWN + "rn", F.row_number().over(w)).where(F.col(OWN + "rn") == 1).select(*docs.columns)
