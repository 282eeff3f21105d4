"""Document fingerprints by a homomorphic multiset hash.

Each paragraph (line) is hashed to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors,
each lane modulo a power of two. So order does not matter, equal multisets of paragraphs have equal fingerprints, and
paragraphs are inserted into or deleted from a fingerprint without the rest of the text (`insert`, `delete`).

A vector has two parts. DENSE lanes modulo 2^16 come from the paragraph's SHAKE-128 and tell multisets apart. PROFILE
lanes modulo 2^32 are signed counts of the paragraph's features: the up to 16 bytes from each word's start, and from
every 32nd byte. Sums of these keep the likeness of two documents: the cosine of their profiles, 0 at least, is near
the share of features that they have in common.

Neighbours: a document is also compared with the next by id and with an edited text, its last quarter replaced by the
next one's start. Rows are cut into ranges of ids, sorted, and streamed holding one document; the first of each range
is sent to the range before as well (that of the first range to the last).

Cases: null counts as empty, which is one empty paragraph. Null ids come first. Rows with equal ids follow in the order
of their texts; one row alone is its own next. An empty table gives an empty result; extra columns are dropped; an id
column named like a result is called so with "_id" behind."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, id_name, partitions

DENSE, PROFILE = 64, 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fingerprint(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace")
    paragraphs = data.split(b"\n")
    dense = np.frombuffer(b"".join([hashlib.shake_128(p).digest(2 * DENSE) for p in paragraphs]), "<u2").reshape(-1, DENSE).sum(axis=0, dtype=np.uint16)
    return dense.astype("<u2").tobytes() + _profile(data).astype("<u4").tobytes()


def _profile(data: bytes) -> np.ndarray:
    n = len(data)
    if not n:
        return np.zeros(PROFILE, np.uint32)
    padded = data + bytes(16)
    b = np.frombuffer(data, np.uint8)
    line_end = b == 10
    gap = line_end | (b == 32)
    after = np.concatenate([[True], gap[:-1]])
    ends = np.concatenate([np.flatnonzero(line_end), [n]])
    starts = np.concatenate([[0], ends[:-1] + 1])
    at = np.flatnonzero(after & ~gap)
    line = np.searchsorted(ends, at, "left")
    # Every 32nd byte of a paragraph: long runs without spaces have features too.
    lengths = ends - starts
    more = -(-lengths // 32)
    far = np.repeat(starts, more) + 32 * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more))
    at, line = np.concatenate([at, far]), np.concatenate([line, np.repeat(np.arange(len(ends)), more)])
    rest = ends[line] - at
    view = np.ndarray((n + 9,), "<u8", padded, strides=(1,))
    low = view[at] & _KEEP[np.minimum(rest, 8)]
    high = view[at + np.minimum(rest, 8)] & _KEEP[np.clip(rest - 8, 0, 8)]
    h = (low * _A) ^ (high * _B)
    h ^= h >> np.uint64(29)
    h *= _B
    lane = (h >> np.uint64(58)).astype(np.int64)
    sign = ((h >> np.uint64(57)) & np.uint64(1)).astype(np.float64) * 2 - 1
    return np.bincount(lane, sign, PROFILE).astype(np.int64).astype(np.uint32)


def _add(a: bytes, b: bytes, sign: int) -> bytes:
    d = 2 * DENSE
    dense = np.frombuffer(a[:d], "<u2") + np.uint16(sign % 2**16) * np.frombuffer(b[:d], "<u2")
    profile = np.frombuffer(a[d:], "<u4") + np.uint32(sign % 2**32) * np.frombuffer(b[d:], "<u4")
    return dense.astype("<u2").tobytes() + profile.astype("<u4").tobytes()


def insert(fp: bytes, paragraphs: str) -> bytes:
    """The fingerprint with more paragraphs."""
    return _add(fp, fingerprint(paragraphs), 1)


def delete(fp: bytes, paragraphs: str) -> bytes:
    """The fingerprint without these paragraphs."""
    return _add(fp, fingerprint(paragraphs), -1)


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(v[2 * DENSE :], "<u4").view(np.int32).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x @ x) * (y @ y))
    return float(min(1.0, max(0.0, x @ y / norm))) if norm else 0.0


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 4) code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document: id, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex), near_edited, near_next."""
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    n = partitions(spark)
    bounds = np.array(sorted(set(rows.approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n))), np.float64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.float64), side="right").astype(np.int32))

    rows = rows.withColumn("part", F.when(F.col("id").isNull(), 0).otherwise(range_of("id")))
    firsts = rows.groupBy("part").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("none")).orderBy("part").collect()  # one row a range
    # Where the first rows of each range go, too: a table of a row a range, and so of a known size.
    before = [firsts[k - 1]["part"] for k in range(len(firsts))]
    kind = docs.schema[id_col].dataType.simpleString()
    sent_to = spark.createDataFrame([(r["part"], None if r["none"] else r["id"], to) for r, to in zip(firsts, before, strict=True)], f"part int, first {kind}, goes int")
    rows = rows.join(F.broadcast(sent_to), "part", "left")
    goes = F.when(F.col("id").eqNullSafe(F.col("first")), F.col("goes"))
    stay, sent = F.struct(F.col("part").alias("to"), F.lit(0).alias("late")), F.struct(goes.alias("to"), F.lit(1).alias("late"))
    moved = rows.select("id", "text", F.explode(F.when(goes.isNull(), F.array(stay)).otherwise(F.array(stay, sent))).alias("s")).select("id", "text", "s.to", "s.late")
    ranges = moved.repartitionById(n, F.col("to")).sortWithinPartitions("late", "id", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, False  # held: (id batch, its row, text, fingerprint)
        for batch in batches:
            out, ids = [], []
            for i, (text, late) in enumerate(zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if over:
                    break
                fp = fingerprint(text)
                if held:
                    was, own_text, own = held
                    new = edited(own_text, text)
                    new_fp = own if new == own_text else fingerprint(new)
                    ids.append(was)
                    out.append((len(own_text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), own.hex(), new_fp.hex(), likeness(own, new_fp), likeness(own, fp)))
                held, over = (batch.column(0).slice(i, 1), text, fp), bool(late)
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c) for c in zip(*out, strict=True))], names)

    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    names = [id_name(id_col, names), *names]
    return ranges.mapInArrow(stream, f"`{names[0]}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
