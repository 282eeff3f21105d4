"""Packing by powers of two.

Each document becomes ids plus an end id, and is cut into pieces as its length's binary digits say: as many pieces of
`context` as fit, then one piece for each digit that is set, longest first. Every piece is a sequence of its own, so no
sequence crosses documents, and as each length is a power of two, nothing is padded. Sequences are bucketed by length:
each task fills batches of `batch_tokens` tokens with sequences of one length as they come, so a batch is a rectangle
without padding, and only the last one of each length in a task may be short. `write_buckets` files each length on its own.

Cases: a null text counts as empty and gives one piece, the end id. Equal rows each give their own pieces. Very long
texts only give more pieces. An empty table gives none. Columns besides id and text are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, read_spec
from .common import col, id_name

CONTEXT, END, BATCH_TOKENS = 4096, 2, 1 << 19
RESULTS = ["start", "length", "ids_crc32", "doc_tokens", "batch", "batch_row", "ids", "sequence_id", "offset"]


def cuts(n: int, context: int) -> list[int]:
    """Lengths of the pieces of n ids, longest first."""
    out = [context] * (n // context)
    rest, bit = n % context, context >> 1
    while rest:
        if rest & bit:
            out.append(bit)
            rest -= bit
        bit >>= 1
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, end_id: int = END, tokenizer: str | None = None, with_ids: bool = True, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row a piece: id, start, length (its bucket), ids (little-endian unsigned 32-bit; on demand), ids_crc32,
    doc_tokens, batch and its place there (batch_row), sequence_id, offset. context must be a power of two."""
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer))
    kind = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        filling: dict[int, tuple[int, int]] = {}  # length -> the batch that is being filled, and how many sequences it has
        fresh = TaskContext.get().partitionId() << 32  # number of the next batch
        for batch in batches:
            row, start, length, crc, total, ids, put = [], [], [], [], [], [], []
            size = 0
            for i, text in enumerate(batch.column(1)):
                got = enc.encode(text.as_py() or "") + end
                n, at = len(got) // 4, 0
                for k in cuts(n, context):
                    part = got[4 * at : 4 * (at + k)]
                    number, rows = filling.get(k, (0, 0))
                    if rows == 0:
                        number, fresh = fresh, fresh + 1
                    put.append((number, rows))
                    filling[k] = (number, rows + 1) if (rows + 2) * k <= batch_tokens else (0, 0)
                    row.append(i), start.append(at), length.append(k), total.append(n), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
                        size += len(part)
                    at += k
                if size > 16 << 20 or i == batch.num_rows - 1:
                    cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), *(pa.array([p[k] for p in put], pa.int64()) for k in (0, 1))]
                    yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), names[: 7 + with_ids])
                    row, start, length, crc, total, ids, put, size = [], [], [], [], [], [], [], 0

    names = [id_name(id_col, RESULTS), *RESULTS[:7]]
    schema = f"`{names[0]}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, batch long, batch_row long" + ", ids binary" * with_ids
    out = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(pieces, schema)
    # A piece is a whole sequence: any number that no other piece has will do.
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Each length's sequences in a folder of their own, for training in one shape a batch."""
    packed.write.partitionBy("length").parquet(path)
