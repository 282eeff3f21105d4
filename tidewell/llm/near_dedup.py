"""SimHash near-dedup at a shingle similarity: the pipeline's form of operator 4 (`simhash.py`).

Two texts are alike if the sets of their word shingles have a Jaccard similarity of at least `likeness`; alike texts
share a component. Words are split and lower-cased as in `simhash`.

First comes operator 4's own search: SimHash fingerprints of 64 bits over these shingles, its segments and balls, table
matches within RADIUS bits verified by complete distances, and components of them. Texts of such a component are a bucket,
whose members the exact similarity of their whole sets then links or leaves apart. But at 0.8, fingerprints of 64 bits
differ in 10 bits on average and in up to 20, and no table of segment balls finds such pairs at a bearable cost: for those
beyond the radius there are further buckets, by bands of minima (MinHash, BANDS of ROWS), whose pairs are verified by complete
Hamming distances of WIDE bits, and what passes by the exact similarity, too.

What can be missed: a pair at 0.8 shares no band with a chance of (1 - 0.8^5)^40 = 1.2e-7, and lies beyond the distance
bound, DEVIATIONS over the mean, with one of 3e-6; a likelier pair with less. Sets of under SMALL shingles
have no distance bound. Nothing less alike is ever linked.

Groups of copies: equal sets are one node from the start. Neighbours in random orders of each bucket are compared first,
round after round in other orders, but only where components still meet in a bucket, and as long as a round joins any (each round in other bands):
a member of a large group of near copies meets a few others a round, and is of their component once one is alike.
What is left apart then is compared in full by distance, but for pairs within the component that has most of a bucket: so
the pairs of a large group are neither put out nor gone through, only those of its bucket's members that no round could
join. Those are compared in blocks of some hundred members, a row a pair of blocks (a smaller bucket: one row), and only close pairs come out. Orders are sorted ranges, which cut a large bucket. Texts are read again for the
nodes that share a bucket and for the rows that stay, by joins on the id whose kind Spark chooses.

Cases: null counts as empty; texts without words are one group; with fewer words than a shingle, the whole sequence is
the shingle. Repeated rows are copies. Rows with one id and different texts are told apart by their sets. An empty table
gives an empty result. Other columns are kept, whatever their names."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import simhash
from .common import bucketed, numbered, written
from .components import FEW, components, lookup
from .simhash import FP, RADIUS

SHINGLE, LIKENESS, BANDS, ROWS, SEED = 5, 0.8, 40, 5, 42
#: Bits of a fingerprint, and the size of a set from which its distances are judged.
WIDE, SMALL, DEVIATIONS = 4096, 32, 4.5
#: Neighbours are compared first in so many bands, then where components meet in up to so many rounds; a member of a
#: bucket is compared with so many that follow it. They change cost only: what is left apart meets in all bands.
CHAINED, ROUNDS, AHEAD = 16, 2, 1
#: Members of a bucket that are compared as a block, about.
BLOCK = 256
_MIX = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64) | np.array([[[0]], [[1]]], np.uint64)
_LANES = np.random.default_rng(SEED + 1).integers(0, 2**64, (2, WIDE // 64), np.uint64) | np.array([[0], [1]], np.uint64)


def all_shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # splits at \x20 and \x09-\x0D, lowers A-Z
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    k, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    return np.array([digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[k - 1 :])], np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(all_shingles(text, shingle))


def node(hashes: np.ndarray) -> int:
    """One number for a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each band; none for an empty set."""
    if not len(hashes):
        return hashes
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[at : at + 4096] ^ _MIX[0]) * _MIX[1]).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set, WIDE bits as longs: a bit is 1 if set in over half of the hashes made from the shingles."""
    ones = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), 1024):
        h = (hashes[at : at + 1024, None] ^ _LANES[0]) * _LANES[1]
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), WIDE // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).view(np.int64)


def farthest(likeness: float) -> int:
    """Differing bits of sets as alike as that: the mean for sets of equal sizes, where it is largest, and DEVIATIONS more."""
    p = math.acos(min(1.0, 2 * likeness / (1 + likeness))) / math.pi
    return math.floor(WIDE * p + DEVIATIONS * math.sqrt(WIDE * p * (1 - p)))


def _key(id_: Column) -> Column:
    return F.coalesce(id_.cast("string"), F.lit(""))


def _alike(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs (a, b) whose sets are as alike as that."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= likeness * (F.size("x") + F.size("y") - shared) - 1e-9).select(*pairs.columns)


def _neighbours(members: DataFrame, order: int, ahead: int, likeness: float) -> DataFrame:
    """(a, b): pairs of members (bucket, node, n, c) that stand up to `ahead` places apart in a random order of a bucket, are of
    different components c, and could be alike by their sizes n. Read off sorted ranges: where a range ends, pairs are left
    out, as those that stand further apart are."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            bucket, node, n, c = (np.concatenate([old, new.to_numpy(zero_copy_only=False)]) for old, new in zip(last, batch.columns, strict=True))
            fresh = len(last[0])  # rows seen before make pairs with new ones only
            found = []
            for k in range(1, ahead + 1):
                near = (bucket[k:] == bucket[:-k]) & (c[k:] != c[:-k]) & (np.minimum(n[k:], n[:-k]) >= likeness * np.maximum(n[k:], n[:-k]) - 1e-9)
                near[: max(0, fresh - k)] = False
                at = np.flatnonzero(near)
                found.append(np.sort(np.stack([node[at], node[at + k]]), axis=0))
            a, b = np.concatenate(found, axis=1)
            last = [x[-ahead:] for x in (bucket, node, n, c)]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    ordered = members.select("bucket", "node", "n", "c", F.xxhash64(F.lit(order), "bucket", "node").alias("o")).repartitionByRange("bucket", "o").sortWithinPartitions("bucket", "o")
    return ordered.select("bucket", "node", "n", "c").mapInArrow(read, "a long, b long").distinct()


def _close_pairs(members: DataFrame, likeness: float) -> DataFrame:
    """(a, b, c, d): pairs of members (bucket, band, node, n, c, fp, bands, and of their bucket most and size) of different
    components c and d, whose sizes and fingerprints allow that they are alike, each from the first bucket that it shares.
    Blocks of members of most are compared with others only: two of them are of one component."""
    member = F.struct("node", "n", "c", "fp", "bands")
    # A bucket of a block or less is one row, with itself and without a join.
    single = members.where(F.col("size") <= BLOCK).groupBy("bucket").agg(F.first("band").alias("band"), F.first("most").alias("most"), F.collect_list(member).alias("y"))
    single = single.select(F.filter("y", lambda s: s["c"] != F.col("most")).alias("x"), "y", "band")
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK))
    blocks = members.where(F.col("size") > BLOCK).groupBy("bucket", (F.col("c") == F.col("most")).alias("of_most"), block.alias("block")).agg(F.first("band").alias("band"), F.collect_list(member).alias("x"))
    blocks = written(blocks, "blocks")
    other = blocks.select(F.col("bucket").alias("same"), F.col("of_most").alias("m"), F.col("block").alias("k"), F.col("x").alias("y"))
    bound = farthest(likeness)

    def columns(rows: pa.Array) -> list[np.ndarray]:
        fields = rows.flatten()
        wide = [f.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(f), -1) for f in fields[3:]]
        return [f.to_numpy(zero_copy_only=False) for f in fields[:3]] + wide

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, band in zip(*batch.columns, strict=True):
                (a, n, c, f, e), (b, m, d, g, h) = columns(left.values), columns(right.values)
                e, h = e[:, : band.as_py()], h[:, : band.as_py()]
                found = []
                for i in range(len(a)):
                    may = np.flatnonzero((d != c[i]) & (np.minimum(m, n[i]) >= likeness * np.maximum(m, n[i]) - 1e-9))
                    far = np.bitwise_count(g[may] ^ f[i]).sum(axis=1, dtype=np.int64) > bound
                    may = may[~far | (np.minimum(m[may], n[i]) < SMALL)]
                    may = may[~(h[may] == e[i]).any(axis=1)]
                    found.append(np.stack([np.full(len(may), a[i]), b[may], np.full(len(may), c[i]), d[may]]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found, axis=1)], ["a", "b", "c", "d"])

    both = blocks.where("NOT of_most").join(other, (F.col("bucket") == F.col("same")) & (F.col("m") | (F.col("block") <= F.col("k"))))
    return both.select("x", "y", "band").unionByName(single).mapInArrow(compare, "a long, b long, c long, d long")


def _meeting(members: DataFrame) -> DataFrame:
    """The members of buckets in which components meet."""
    open_ = members.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("bucket")
    return members.join(open_, "bucket", "left_semi")


def link_components(texts: DataFrame, nodes: DataFrame, shingle: int, likeness: float) -> DataFrame:
    """texts: (key, text). nodes: one row a set (node, key, n, bands, FP), written. -> (node, root) for every node."""
    near = lambda n, m: F.least(n, m) >= likeness * F.greatest(n, m) - 1e-9
    # Operator 4's components are one more band, behind those of minima.
    some = nodes.where("n > 0").select("node", "n", FP)
    prints = written(some.groupBy(FP).agg(F.count("*").alias("weight")), "distinct")
    roots = written(prints.join(simhash.link_components(prints.select(FP), RADIUS), FP), "roots")
    searched = lookup(some, roots, FP, some.count()).select("node", "n", F.lit(BANDS).alias("band"), F.xxhash64(F.lit(BANDS), "root").alias("bucket"))
    put = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket")).unionByName(searched)
    several = put.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    put = written(put.join(several, "bucket", "left_semi").select("node", "n", "band", "bucket", F.col("node").alias("c")), "buckets")

    wanted = written(put.select("node").distinct().join(nodes.select("node", "key", "bands"), "node"), "proposed")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(x, shingle) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node(h) for h in made], pa.int64()), pa.array([h.view(np.int64) for h in made], longs), pa.array([fingerprint(h) for h in made], longs)], ["node", "set", "fp"])

    longs = pa.list_(pa.int64())
    sets = texts.join(wanted.select("key").distinct(), "key", "left_semi").select("text").mapInArrow(sets_of, "node long, set array<long>, fp array<long>")
    # They are joined by node again and again.
    sets = bucketed(sets.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"), F.first("fp").alias("fp")), "node", "sets")

    first, members = None, put
    for order in range(ROUNDS + 1):
        bands_ = [BANDS, *range(CHAINED)] if not order else range(CHAINED + (order - 1) * (BANDS - CHAINED) // ROUNDS, CHAINED + order * (BANDS - CHAINED) // ROUNDS)
        pairs = _neighbours(members.where(F.col("band").isin(*bands_)), order, AHEAD, likeness)
        seen = Observation()
        linked = written(_alike(pairs, sets, likeness).observe(seen, F.count(F.lit(1)).alias("n")), "links")
        if seen.get["n"]:
            # A component's name stands for its members: links are between names, and members follow theirs.
            names = members.select("node", "c").distinct()
            of = lambda x, y: names.select(F.col("node").alias(x), F.col("c").alias(y))  # noqa: B023, E731
            merged = components(linked.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
            named, most = merged.withColumnRenamed("node", "c"), 2 * seen.get["n"]
            if most > FEW:
                named = members.groupBy("c").agg(F.count("*").alias("weight")).join(named, "c")
            renamed = lookup(members, named, "c", members.count(), most)
            members = renamed.select("node", "n", "band", "bucket", F.coalesce("root", "c").alias("c"))
            first = merged if first is None else first.unionByName(merged)
        elif order:
            break
        members = written(_meeting(members), "meeting")

    # What is left: members carry what tells most pairs apart. Of each bucket the component with most members is not gone through.
    most = members.groupBy("bucket", "c").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "c"))["c"].alias("most"))
    weighed = members.groupBy("bucket").agg(F.count("*").alias("weight")).join(most, "bucket")
    full = lookup(members, weighed.withColumnRenamed("weight", "size").withColumn("weight", F.col("size")), "bucket", members.count()).join(sets.select("node", "fp"), "node").join(wanted.select("node", "bands"), "node")
    pairs = _close_pairs(written(full, "open"), likeness)
    last = components(_alike(pairs, sets, likeness).select(F.col("c").alias("a"), F.col("d").alias("b")))
    # Names of one round are nodes of the next: all of them together are edges from a name to the name that took it.
    names = last.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if first is not None:
        names = names.unionByName(first.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = components(names)
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """docs without near copies: of each component the document with the smallest id stays (rows without one come last;
    among rows with that id, the smallest node and then the smallest text)."""
    names = docs.columns
    own = [f"c{i}" for i in range(1, len(names) + 1)]
    rows = numbered(docs, text_col, names)
    id_ = F.col(own[names.index(id_col)])
    narrow = rows.select(id_.alias("id"), F.col("c0").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [all_shingles(x, shingle) for x in batch.column(1).to_pylist()]
            prints = pa.array(np.array([simhash.majority(h) for h in every], np.uint64).view(np.int64))
            made = [np.unique(h) for h in every]
            cols = [pa.array([node(h) for h in made], pa.int64()), pa.array([len(h) for h in made], pa.int64()), pa.array([bands(h).view(np.int64) for h in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, prints], ["id", "node", "n", "bands", FP])

    made = narrow.mapInArrow(minima, f"id {kind}, node long, n long, bands array<long>, {FP} long")
    # Beside each set: the smallest id that has it, and how many rows.
    nodes = made.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("s"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(FP).alias(FP))
    nodes = written(nodes.select("node", "s.none", "s.id", _key(F.col("s.id")).alias("key"), "rows", "n", "bands", FP), "minhashes")
    roots = link_components(narrow.select(_key(F.col("id")).alias("key"), "text"), nodes, shingle, likeness)
    first = nodes.select("node", "none", "id").join(roots, "node").groupBy("root").agg(F.min(F.struct("none", "id", "node")).alias("s"))
    stay = written(first.select(F.col("s.node").alias("node"), _key(F.col("s.id")).alias("key")), "representatives")

    # An id names its text unless rows share it: only then are sets looked at again.
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, wants = batch.column(len(own) + 1).to_pylist(), batch.column(len(own) + 2).to_pylist()
            keep = [not s or node(shingles(batch.column(0)[i].as_py(), shingle)) == w for i, (s, w) in enumerate(zip(shared, wants, strict=True))]
            yield pa.RecordBatch.from_arrays(batch.columns[1:], out.names).filter(pa.array(keep, pa.bool_()))

    several = written(narrow.groupBy(_key(F.col("id")).alias("key")).count().where("count > 1").select("key", F.lit(True).alias("shared")), "shared-ids")
    found = rows.withColumn("key", _key(id_)).join(stay.join(several, "key", "left"), "key").select("c0", *own, "shared", "node", "key")
    out = found.drop("c0").schema
    w = Window.partitionBy("key", "node").orderBy(own[names.index(text_col)])
    kept = found.mapInArrow(check, out)
    alone, tied = kept.where("shared IS NULL"), kept.where("shared").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return alone.select(*own).unionByName(tied.select(*own)).toDF(*names)
