"""Exact deduplication over an extendible-hash index on shared files.

Texts are equal when identical after lower-casing A-Z. A document's key is the 64-bit XXH64 of its normalised text.
Owner tasks process key ranges: the key's first bits name the owner, and an owner gets its keys in order. For each
document it probes its extendible-hash directory for the bucket, and the bucket for the chain of texts with that key,
which are told apart by comparing bytes: a text that is there already is a copy, a new one is filed. A bucket that
overfills is split by the next bit of its keys, and if it was as deep as the directory, the directory doubles. Buckets
left of the current key are final and written, so an owner holds a bucket and not its range. The index is a Parquet
table in the shared folder: one entry a distinct text, and beside the entries the ids of further copies as they come.

Skew: copies within an Arrow batch are merged before the shuffle, by their bytes, and their ids sent as a list. So a
group with a third of all rows reaches its owner as one row a batch, which is compared and passed on, not held.

Cases: a null text counts as empty (and stays null where rows are returned). Of equal texts the row with the largest
id stays; null ids come last. Of repeated rows (same id, equal text) one stays. An empty table gives an empty index.
Very long texts are rows like others. Other columns are those of the row that stays, whatever their names."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, partitions, written

#: A bucket overfills beyond so many texts or so many bytes of them.
BUCKET, BUCKET_BYTES = 1024, 16 << 20


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()  # bytes.lower() changes A-Z only


@dataclass
class Entry:
    """A distinct text: its copies' count, the row that stays (id, the list that brought it and its place there), and the first list of ids."""

    key: int
    data: bytes
    place: int  # in the chain of its key
    best: object
    row: pa.RecordBatch
    ids: list
    at: int
    list_no: int = 0
    lists: int = 1
    count: int = 0


@dataclass
class Bucket:
    prefix: int
    depth: int
    chains: dict[int, list[Entry]] = field(default_factory=dict)
    texts: int = 0
    size: int = 0


class Directory:
    """Extendible-hash directory over the bits of a key that follow the owner's. Keys come in ascending order."""

    def __init__(self, owner_bits: int, capacity: int = BUCKET, capacity_bytes: int = BUCKET_BYTES):
        self.owner_bits, self.capacity, self.capacity_bytes, self.depth = owner_bits, capacity, capacity_bytes, 0
        self.slots = [Bucket(0, 0)]
        self.open = [self.slots[0]]  # not written yet, by prefix

    def slot(self, key: int) -> int:
        return ((key << self.owner_bits) & (2**64 - 1)) >> (64 - self.depth) if self.depth else 0

    def find(self, key: int, data: bytes) -> Entry | None:
        """The entry of a text, if it is filed."""
        return next((e for e in self.slots[self.slot(key)].chains.get(key, ()) if e.data == data), None)

    def insert(self, entry: Entry) -> None:
        while True:
            bucket = self.slots[self.slot(entry.key)]
            full = bucket.texts >= self.capacity or bucket.size + len(entry.data) > self.capacity_bytes
            # Equal keys can't be split: their chain may exceed the capacity.
            if not full or bucket.depth >= 64 - self.owner_bits or not bucket.chains.keys() - {entry.key}:
                break
            self.split(bucket)
        self.file(bucket, entry)

    @staticmethod
    def file(bucket: Bucket, entry: Entry) -> None:
        chain = bucket.chains.setdefault(entry.key, [])
        entry.place = len(chain)
        chain.append(entry)
        bucket.texts += 1
        bucket.size += len(entry.data)

    def split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.slots = [b for b in self.slots for _ in range(2)]
            self.depth += 1
        halves = [Bucket(bucket.prefix * 2 + i, bucket.depth + 1) for i in range(2)]
        span = 1 << (self.depth - bucket.depth)
        first = bucket.prefix * span
        for i in range(span):
            self.slots[first + i] = halves[i >= span // 2]
        for key, chain in bucket.chains.items():
            for entry in chain:
                self.file(self.slots[self.slot(key)], entry)
        at = self.open.index(bucket)
        self.open[at : at + 1] = halves

    def closed(self, key: int | None) -> list[Bucket]:
        """The buckets left of a key, or all: they are final."""
        at = len(self.open) if key is None else self.open.index(self.slots[self.slot(key)])
        done, self.open = self.open[:at], self.open[at:]
        for bucket in done:  # what is written need not be held
            span = 1 << (self.depth - bucket.depth)
            self.slots[bucket.prefix * span : (bucket.prefix + 1) * span] = [None] * span
        return done


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = BUCKET) -> DataFrame:
    """A table of entries and further lists. An entry, one a distinct text: c1, c2, ... (the columns of the row that stays),
    key (shifted into signed range), place in its chain, bucket (the prefix of its bits), ids (the first list), stays
    (number of the list that holds the row that stays, and its place there), count and text_sha256. A further list: key,
    place, ids and number."""
    spark, names = docs.sparkSession, docs.columns
    rows = numbered(docs, text_col, names)
    id_at = names.index(id_col) + 1
    kind = rows.schema[id_at].dataType
    bits = max(1, (partitions(spark) - 1).bit_length())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a distinct text of a batch: the row with the largest id, its key, its place and all ids."""
        for batch in batches:
            ids, found = batch.column(id_at).to_pylist(), {}
            for i, text in enumerate(batch.column(0)):
                found.setdefault(normalised(text.as_py()), []).append(i)
            best = [max(at, key=lambda i: (ids[i] is not None, ids[i])) if len(at) > 1 else at[0] for at in found.values()]
            keys = pa.array([xxhash.xxh64_intdigest(data) - 2**63 for data in found], pa.int64())
            lists = pa.array([[ids[i] for i in at] for at in found.values()], pa.list_(batch.schema.field(id_at).type))
            took = batch.take(pa.array(best, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, keys, lists, pa.array([at.index(b) for at, b in zip(found.values(), best, strict=True)], pa.int32())], [*took.schema.names, "key", "ids", "at"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    ids_type = f"array<{kind.simpleString()}>"
    merged = rows.mapInArrow(merge, f"{schema}, key long, ids {ids_type}, at int")
    owner = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2**63))), 64 - bits).cast("int")
    ranges = merged.repartitionById(1 << bits, owner).sortWithinPartitions("key")
    n = len(names) + 1
    out = ["key", "place", "ids", "number", "stays", "stays_at", "count", "bucket", "text_sha256"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory, first, id_type, types = None, None, None, None

        def entries(done: list[Bucket]) -> Iterator[pa.RecordBatch]:
            for bucket in done:
                filed = [e for chain in bucket.chains.values() for e in chain]
                if filed:
                    kept = pa.Table.from_batches([e.row for e in filed]).combine_chunks().to_batches()[0]
                    prefix = f"{first:0{bits}b}" + (f"{bucket.prefix:0{bucket.depth}b}" if bucket.depth else "")
                    cols = [pa.array([e.key - 2**63 for e in filed], pa.int64()), pa.array([e.place for e in filed], pa.int32()), pa.array([e.ids for e in filed], id_type), pa.nulls(len(filed), pa.int64())]
                    cols += [pa.array([e.list_no for e in filed], pa.int64()), pa.array([e.at for e in filed], pa.int32()), pa.array([e.count for e in filed], pa.int64())]
                    cols += [pa.array([prefix] * len(filed)), pa.array([hashlib.sha256(e.data).hexdigest() for e in filed])]
                    yield pa.RecordBatch.from_arrays([*kept.columns, *cols], [*kept.schema.names, *out])

        for batch in batches:
            types, id_type = batch.schema, batch.schema.field(n + 1).type
            further = []  # (key, place, ids, number) of copies
            for i, (key, text, at) in enumerate(zip(batch.column(n).to_pylist(), batch.column(0), batch.column(n + 2).to_pylist(), strict=True)):
                key += 2**63
                if directory is None or first != key >> (64 - bits):
                    yield from entries(directory.closed(None) if directory else [])
                    directory, first = Directory(bits, capacity), key >> (64 - bits)
                data, ids = normalised(text.as_py()), batch.column(n + 1)[i].as_py()
                entry = directory.find(key, data)
                if entry is None:
                    yield from entries(directory.closed(key))
                    entry = Entry(key, data, 0, ids[at], batch.slice(i, 1).select(range(1, n)), ids, at)
                    directory.insert(entry)
                else:
                    further.append((key - 2**63, entry.place, ids, entry.lists))
                    if ids[at] is not None and (entry.best is None or ids[at] > entry.best):
                        entry.best, entry.row, entry.list_no, entry.at = ids[at], batch.slice(i, 1).select(range(1, n)), entry.lists, at
                    entry.lists += 1
                entry.count += len(ids)
            if further:
                key, place, ids, number = zip(*further, strict=True)
                cols = [pa.array(key, pa.int64()), pa.array(place, pa.int32()), pa.array(list(ids), id_type), pa.array(number, pa.int64())]
                cols = [*(pa.nulls(len(key), types.field(c).type) for c in range(1, n)), *cols, *(pa.nulls(len(key), t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, [*types.names[1:n], *out])
        yield from entries(directory.closed(None) if directory else [])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return written(ranges.mapInArrow(own, f"{kept}, key long, place int, ids {ids_type}, number long, stays long, stays_at int, count long, bucket string, text_sha256 string"), "extendible-hash")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns of docs: the index holds them."""
    return index(docs, id_col, text_col).where("number IS NULL").select(*(f"c{i}" for i in range(1, len(docs.columns) + 1))).toDF(*docs.columns)


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, dropped ones too: id, keep_id, group_size, kept, text_sha256. The index has them all: an entry's
    own list, and further lists, which meet their entry by key and place."""
    made = index(docs.select(id_col, text_col), id_col, text_col)
    entries = made.where("number IS NULL").select("key", "place", F.col("c1").alias("keep_id"), F.col("count").alias("group_size"), "stays", "stays_at", "text_sha256", "ids")
    copies = made.where("number IS NOT NULL").select("key", "place", F.col("ids").alias("more"), "number")
    later = copies.join(entries.where(F.col("group_size") > F.size("ids")).drop("ids"), ["key", "place"])
    all_ = entries.withColumn("number", F.lit(0).cast("long")).unionByName(later.withColumnRenamed("more", "ids"))
    rows = all_.select(F.posexplode("ids").alias("at", "id"), "keep_id", "group_size", ((F.col("number") == F.col("stays")) & (F.col("at") == F.col("stays_at"))).alias("kept"), "text_sha256")
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")
