"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling (gear) hash of the last 32 bytes is zero in its top bits, so passages that documents
share give the same chunks wherever they stand. A chunk that occurs in several places is encoded once, in the document
that owns it (the first by key), and its ids are sent to the others; all else is encoded where it stands. Texts that are
equal are encoded once, too.

Joins: a cut may fall within a word, so what a chunk gives near its ends can't be trusted. Each chunk keeps its first and
last pieces (what the tokenizer merges on its own: words, signs) beside the ids of what lies between. Where two chunks
meet, a window over the last pieces of one and the first of the other is encoded again, and its pieces are compared
with theirs: on the left the window must begin with the piece that stood there, on the right some piece of the window
must be the same, at the same place, as one of the chunk. If not, the window is doubled, until it holds all pieces that
both sides kept; a document that does not agree then is encoded whole. From a place where both start the same piece on,
both go on alike, as a piece hangs on what follows its start alone (`bpe.splices`); a window reaches farther than any
special token. Texts of a tokenizer of which this isn't known are encoded whole, equal ones once.

Cases: null counts as empty: no tokens. Repeated rows and null ids each get an answer. A chunk without
inner pieces is part of the windows around it. An empty table gives an empty result; extra columns are dropped; an id column named like a result is called so with "_id" behind. Only chunk digests are grouped by
chunk, partial counts first; a chunk in a third of all documents is one row for each that lacks it, spread by the
run-time split of skewed joins."""

from __future__ import annotations

import hashlib
import pickle
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder, read_spec, splices
from .common import col, id_name, partitions, written

#: A cut stands after one byte in 2^CUT_BITS.
CUT_BITS = 10
GEAR = np.frombuffer(hashlib.shake_128(b"gear").digest(1024), "<u4")
KEY = 16


def cuts(data: bytes, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of UTF-8 data."""
    b = np.frombuffer(data, np.uint8)
    h = GEAR[b].copy()
    for s in (1, 2, 4, 8, 16):
        add = h[:-s] << np.uint32(s)
        h[s:] += add
    # A cut within a character moves to its end.
    ok = np.concatenate([(b[1:] & 0xC0) != 0x80, [True]]) if len(b) else np.zeros(0, bool)
    at = np.flatnonzero((h >> np.uint32(32 - bits)) == 0)
    ends = np.flatnonzero(ok)
    out = np.unique(ends[np.searchsorted(ends, at)] + 1).tolist() if len(at) else []
    return out if not len(b) or out and out[-1] == len(b) else [*out, len(b)]


def digest(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(data)


#: Pieces that a window holds of each side at first, and at least.
PIECES = 3
Pieces = list[tuple[bytes, bytes]]
#: What a chunk leaves behind: all its text, or its first pieces, the ids between and its last pieces.
Unit = bytes | tuple[tuple, bytes, tuple]


def reach(enc: Encoder) -> int:
    """Bytes that a window must reach to each side: more than any special token has."""
    return 1 + max((len(s.encode()) for s in enc.special), default=0)


def folded(pieces: Pieces) -> tuple[bytes, bytes, bytes]:
    sizes = array("I", [len(x) for piece in pieces for x in piece])
    return b"".join(t for t, _ in pieces), b"".join(i for _, i in pieces), sizes.tobytes()


def unfolded(folds: tuple[bytes, bytes, bytes]) -> Pieces:
    text, ids, sizes = folds
    out, a, b = [], 0, 0
    n = array("I", sizes)
    for x, y in zip(n[::2], n[1::2], strict=True):
        out.append((text[a : a + x], ids[b : b + y]))
        a, b = a + x, b + y
    return out


def ids_of(pieces: Pieces) -> bytes:
    return b"".join([ids for _, ids in pieces])


def edge(pieces: Pieces, least: int, far: int) -> int | None:
    """How many of the first pieces hold `least` and `far` bytes behind these; None if all don't."""
    size = 0
    for n, (text, _) in enumerate(pieces, 1):
        size += len(text) if n > least else 0
        if n > least and size >= far:
            return n
    return None


def unit(enc: Encoder, data: bytes) -> Unit:
    far = reach(enc)
    if not enc.separable:
        pieces = enc.pieces(data.decode())
        a, b = edge(pieces, PIECES, far), edge(pieces[::-1], PIECES, far)
        if not a or not b or a >= (b := len(pieces) - b):
            return data
        return folded(pieces[:a]), ids_of(pieces[a:b]), folded(pieces[b:])
    # White space is no piece's part: what lies between two of it is encoded without telling its pieces.
    size, first, last = 2 * far, 0, len(data)
    head = tail = []
    while not (edge(head, PIECES, far) and edge(tail[::-1], PIECES, far)):
        first, last = _gap(data, size, 1), _gap(data, len(data) - size, -1)
        if not 0 <= first < last:
            return data
        head, tail, size = enc.pieces(data[:first].decode()), enc.pieces(data[last:].decode()), 2 * size
    return folded(head), enc.encode(data[first:last].decode()), folded(tail)


def _gap(data: bytes, at: int, step: int) -> int:
    """The next white space from a place on, forwards or backwards; -1 for none."""
    if at < 0:
        return -1
    if step > 0:
        return min((i for i in (data.find(b" ", at), data.find(b"\n", at)) if i >= 0), default=-1)
    return max(data.rfind(b" ", 0, at), data.rfind(b"\n", 0, at))


def bridged(enc: Encoder, held: Pieces, gap: bytes, head: Pieces | None) -> bytes | None:
    """The ids from the first held piece to the last of head (None: the text's end), with a text between them that is
    encoded here; None if the two sides don't agree. A text's start holds no pieces."""
    far, k = reach(enc), PIECES
    if not gap and (not held or head is None):
        return ids_of(held or head or [])
    while True:
        i = len(held) - (edge(held[::-1], k, far) or len(held))
        m = (edge(head, k, far) or len(head)) if head else 0
        before = b"".join([t for t, _ in held[i:]])
        window = b"".join([before, gap, *(t for t, _ in (head or [])[:m])])
        got = enc.pieces(window.decode())
        if i == 0 or got[0] == held[i]:
            if head is None:
                return ids_of(held[:i]) + ids_of(got)
            if found := _agreed(got, head[:m], len(before) + len(gap), len(window) - far):
                return ids_of(held[:i]) + ids_of(got[: found[0]]) + ids_of(head[found[1] :])
        if i == 0 and m == len(head or []):
            return None
        k *= 2


def _agreed(got: Pieces, head: Pieces, at: int, end: int) -> tuple[int, int] | None:
    """Which piece of got and which of head, which begins at a place of the window, are the first to be the same: none is its
    side's last, and both end before `end`."""
    starts, place = {}, 0
    for j, (text, _) in enumerate(got[:-1]):
        starts[place] = j
        place += len(text)
    for q, piece in enumerate(head[:-1]):
        j = starts.get(at)
        at += len(piece[0])
        if at > end:
            return None
        if j is not None and got[j] == piece:
            return j, q
    return None


def joined(enc: Encoder, units: list[Unit]) -> bytes | None:
    """The ids of the whole text from those of its units; None if two of them can't be made to agree."""
    out, held, gap = [], [], []
    for u in units:
        if isinstance(u, bytes):
            gap.append(u)
            continue
        head, ids, tail = u
        bridge = bridged(enc, held, b"".join(gap), unfolded(head))
        if bridge is None:
            return None
        out += [bridge, ids]
        held, gap = unfolded(tail), []
    bridge = bridged(enc, held, b"".join(gap), None)
    return None if bridge is None else b"".join([*out, bridge])


def digests(enc: Encoder, names: list[str], numbers: list[str], ids: bytes) -> tuple[int, str, str]:
    got = np.frombuffer(ids, "<u4").tolist()
    said = " ".join([numbers[i] for i in got]), enc.decoded(ids, names)
    return len(got), *(hashlib.sha256(x.encode()).hexdigest() for x in said)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every document: id, n_tokens, ids_sha256, decoded_sha256; with_ids: and ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    read = read_spec(tokenizer)
    in_parts = splices(read)
    spec = spark.sparkContext.broadcast(read)
    narrow = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, chunks = [], []
            for text in batch.column(1).to_pylist():
                data = (text or "").encode("utf-8", "replace")
                ends = cuts(data)
                keys.append(digest(data))
                chunks.append([digest(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)] if in_parts and len(ends) > 1 else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(chunks, pa.list_(pa.binary()))], ["id", "key", "chunks"])

    marked = written(narrow.mapInArrow(marks, f"id {kind}, key binary, chunks array<binary>"), "chunk-marks")
    # Which chunks occur more than once, and who owns them. A text that comes again counts once.
    texts = marked.where(F.size("chunks") > 0).groupBy("key").agg(F.first("chunks").alias("chunks"))
    places = written(texts.select("key", F.posexplode("chunks").alias("pos", "chunk")), "chunk-places")
    # Written, so that the join after it can split a chunk that many documents share.
    shared = written(places.groupBy("chunk").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("owner")).where("n > 1").select("chunk", "owner"), "chunk-owners")
    told = places.join(shared, "chunk").select("key", F.struct("pos", "chunk", ((F.col("owner.key") == F.col("key")) & (F.col("owner.pos") == F.col("pos"))).alias("own")).alias("told"))
    told = told.groupBy("key").agg(F.collect_list("told").alias("told"))  # a document's own chunks

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            seen = {}
            for text in batch.column(0).to_pylist():
                data = (text or "").encode("utf-8", "replace")
                if (key := digest(data)) not in seen:
                    seen[key] = zip_.compress(data)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], ["key", "data"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0: a finished document; 1: a document that waits for chunks; 2: a shared chunk."""
        enc, unzip = encoder(spec.value), zstandard.ZstdDecompressor()
        names, numbers = enc.names(), [str(i) for i in range(enc.full.get_vocab_size(with_added_tokens=True))]
        last = None
        for batch in batches:
            rows, size = [], 0
            for key, data, told_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == last:  # sorted by key: the same text from another batch
                    continue
                last, data = key, unzip.decompress(data)
                if not told_:
                    rows.append((0, key, None, None, *finished(enc, names, numbers, enc.encode(data.decode()))))
                else:
                    ends, at = cuts(data), 0
                    units, needs = [], []
                    begin = [0, *ends]
                    for t in sorted(told_, key=lambda t: t["pos"]):
                        a, b = begin[t["pos"]], ends[t["pos"]]
                        if a > at:
                            units.append(unit(enc, data[at:a]))
                        if t["own"]:
                            units.append(unit(enc, data[a:b]))
                            rows.append((2, t["chunk"], pickle.dumps(units[-1]), None, *nothing))
                        else:
                            units.append(None)
                            needs.append(t["chunk"])
                        at = b
                    if at < len(data):
                        units.append(unit(enc, data[at:]))
                    if needs:
                        rows.append((1, key, pickle.dumps(units), needs, *nothing))
                    else:
                        rows.append((0, key, None, None, *finished(enc, names, numbers, whole(enc, units, data))))
                size += len(data)
                if size > 16 << 20:
                    yield table_of(rows)
                    rows, size = [], 0
            if rows:
                yield table_of(rows)

    def whole(enc: Encoder, units: list[Unit], data: bytes) -> bytes:
        ids = joined(enc, units)
        return enc.encode(data.decode()) if ids is None else ids

    result = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.binary()}
    result_schema, nothing = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary", (None,) * 4

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"kind": pa.int32(), "key": pa.binary(), "made": pa.binary(), "needs": pa.list_(pa.binary())} | result
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def finished(enc: Encoder, names: list[str], numbers: list[str], ids: bytes) -> tuple:
        return (*digests(enc, names, numbers, ids), ids if with_ids else None)

    told_to = told.withColumnRenamed("key", "k")
    # Equal texts from several batches must meet in one partition, whatever kind of join follows.
    data = narrow.select("text").mapInArrow(packed, "key binary, data binary").repartition(partitions(spark), "key")
    both = data.join(told_to, data["key"] == told_to["k"], "left").select("key", "data", "told").sortWithinPartitions("key")
    made = written(both.mapInArrow(encoded, f"kind int, key binary, made binary, needs array<binary>, {result_schema}"), "encoded")
    done = made.where("kind = 0").select("key", *result)
    waiting, chunks = made.where("kind = 1"), made.where("kind = 2").select(F.col("key").alias("chunk"), F.col("made").alias("unit"))
    fetched = waiting.select("key", F.explode(F.array_distinct("needs")).alias("chunk")).join(chunks, "chunk").groupBy("key").agg(F.collect_list(F.struct("chunk", "unit")).alias("got"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Waiting documents with the units that they were sent, in the order of their needs; without ids, no agreement."""
        enc = encoder(spec.value)
        names, numbers = enc.names(), [str(i) for i in range(enc.full.get_vocab_size(with_added_tokens=True))]
        for batch in batches:
            out = []
            for units, needs, got in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                sent = {g["chunk"]: pickle.loads(g["unit"]) for g in got}
                wanted = iter(needs)
                ids = joined(enc, [sent[next(wanted)] if u is None else u for u in pickle.loads(units)])
                out.append(nothing if ids is None else finished(enc, names, numbers, ids))
            cols = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, result.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["key", *result])

    def anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, unzip = encoder(spec.value), zstandard.ZstdDecompressor()
        names, numbers = enc.names(), [str(i) for i in range(enc.full.get_vocab_size(with_added_tokens=True))]
        for batch in batches:
            out = [finished(enc, names, numbers, enc.encode(unzip.decompress(d).decode())) for d in batch.column(1).to_pylist()]
            cols = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, result.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["key", *result])

    shape = f"key binary, {result_schema}"
    repaired = written(waiting.select("key", "made", "needs").join(fetched, "key").mapInArrow(put_together, shape), "repaired")
    lost = repaired.where("n_tokens is null").select("key")
    repaired = repaired.where("n_tokens is not null")
    if not lost.isEmpty():  # documents, or none as a rule
        repaired = repaired.unionByName(data.join(lost, "key").dropDuplicates(["key"]).mapInArrow(anew, shape))
    results = done.unionByName(repaired)
    columns = [F.col("id").alias(id_name(id_col, list(result))), "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    return marked.select("id", "key").join(results, "key").select(*columns)
