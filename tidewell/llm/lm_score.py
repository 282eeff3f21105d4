"""Language-model scoring by cross-entropy difference (Moore and Lewis, 2010).

Two bigram models of the same form are counted over the whole corpus: a target model over the documents that the
labels call good, a background model over all of them. They share one vocabulary, all words of the corpus, so no word
is unknown. A document's score is its mean loss per token under the target model minus that under the background
model: the lower, the more target-like. Both models are taken without the document that they score (its own counts are
subtracted), so a document that carries a label is judged like any other.

    p(w | v) = (n(v, w) + MU * p(w)) / (n(v) + MU),    p(w) = (n(w) + 1) / (n + size of the vocabulary)

Counting and looking up are one exchange. Texts are read once and filed in batches of about BATCH_CHARS characters,
as numbers of the batch's own words. Each batch sends its distinct words and bigrams with their counts to the buckets
of their 64-bit keys; a bucket sums each key over all batches and answers each batch with the sums of what it sent;
with these the batch scores its documents. So counts are exact, whatever the size of the corpus (but for two keys that
share all bits that are compared, 48 and those that choose the bucket), and nothing of the models reaches the driver or
every worker: only the number of words, of tokens, and of distinct words do.

Skew: a word or bigram is sent once a batch, however frequent. There are BUCKETS buckets to a shuffle partition, handled
one by one. Labels meet documents by id in narrow rows; texts are not shuffled.

Memory: a task holds the numbers of one batch (4 bytes a token, one text at least) and what its distinct words and bigrams
count; what is taken place by place (eights of bytes a token, several times) is taken for some whole documents at a time, SLICE
places about, and nothing of a batch outlives its rows.

Cases: null and empty texts, and those without words, have no tokens, null losses and score 0. Without labelled
documents the target model is uniform. Labels of one id are merged (good if any says so); null ids are not labelled.
Repeated rows each count and each get an answer, which leaves out only the row itself. One very long text is a batch of
its own. An empty table gives an empty result; extra columns are dropped; an id column named like a result
is called so with "_id" behind."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, id_name, partitions, written

MU, BATCH_CHARS, BUCKETS = 1000.0, 8 << 20, 4
#: Places that are scored at once, about: cost only.
SLICE = 1 << 17
START = 0
WORD = re.compile(r"\w+|[^\w\s]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class _Numbers(dict):
    """Word -> its number in the batch, from 1 on; START is 0."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        return n


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and where each value stands among them."""
    order = np.argsort(values)
    values = values[order]
    fresh = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    at = np.empty(len(values), np.int32)
    at[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return values[fresh], at


class Grams:
    """The distinct words and bigrams of a batch: words by number, then bigrams in the order of their words' numbers."""

    def __init__(self, words: np.ndarray, seq: np.ndarray, buckets: int):
        self.seq, self.starts = seq, np.flatnonzero(seq == START)
        inner = seq[1:] != START  # no bigram runs from one text into the next
        both = seq[:-1][inner].astype(np.int64)
        both <<= 32
        both |= seq[1:][inner]
        pairs, self.pair = _distinct(both)
        del both, inner
        h = words.view(np.uint64)
        keys = np.concatenate([_mix(h), _mix(_mix(h[pairs >> 32]) * np.uint64(3) + h[pairs & 0xFFFFFFFF])])
        bucket = (keys >> np.uint64(48)) % np.uint64(buckets)
        self.width, self.order = len(words), np.argsort(bucket.astype(np.uint16), kind="stable")
        self.keys, sizes = keys[self.order], np.bincount(bucket.astype(np.int64), minlength=buckets)
        self.buckets = np.flatnonzero(sizes)
        self.ends = np.cumsum(sizes[self.buckets])

    def slices(self) -> Iterator[tuple[int, int]]:
        """(first, end) of runs of whole documents, of about SLICE places, or one that has more."""
        ends = np.append(self.starts[1:], len(self.seq))
        first = 0
        while first < len(ends):
            end = max(first + 1, int(np.searchsorted(ends, self.starts[first] + SLICE, "right")))
            yield first, end
            first = end

    def places(self, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers of a run of documents, each after its START, and the numbers of their bigrams."""
        a, b = self.starts[first], self.starts[end] if end < len(self.starts) else len(self.seq)
        return self.seq[a:b], self.pair[a - first : b - end]  # a START makes no bigram

    def counts(self, picked: np.ndarray) -> np.ndarray:
        """How often each word and bigram comes within the picked documents, in the order of the buckets."""
        n = np.zeros(len(self.keys), np.int64)
        for first, end in self.slices():
            if picked[first:end].any():
                seq, pair = self.places(first, end)
                of = np.cumsum(seq == START) - 1
                taken = picked[first:end][of]
                for x, m in ((seq[taken], n[: self.width]), (pair[taken[seq != START]], n[self.width :])):
                    x, k = np.unique(x, return_counts=True)
                    m[x] += k
        return n[self.order]


def _numbers(n: np.ndarray) -> bytes:
    kind = "<u4" if n.max(initial=0) < 2**32 else "<u8"
    return kind.encode() + zstandard.ZstdCompressor(level=1).compress(n.astype(kind).tobytes())


def _read(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[3:]), data[:3].decode()).astype(kind)


def _own(docs: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """At each place, how often its gram comes in its document."""
    _, at, n = np.unique(docs << 32 | grams, return_inverse=True, return_counts=True)
    return n[at]


def batches_of(narrow: DataFrame) -> DataFrame:
    """narrow: (id, text) -> one row a batch: its documents' ids and lengths, the hashes of its words by number, and seq,
    the numbers of all texts' words, each text after a START."""
    kind = narrow.schema["id"].dataType.simpleString()

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, seq, numbers, chars, done = [], [], array("I"), _Numbers(), 0, TaskContext.get().partitionId() << 32

        def filed() -> pa.RecordBatch:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in ["", *numbers]], np.uint64).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (pa.concat_arrays(ids), pa.array(lengths, pa.int64()), pa.array(hashes))]
            return pa.RecordBatch.from_arrays([pa.array([done], pa.int64()), *lists, pa.array([_numbers(np.frombuffer(seq, np.uint32))], pa.binary())], ["batch", "ids", "lengths", "words", "seq"])

        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                ids.append(batch.column(0).slice(i, 1)), lengths.append(len(words))
                seq.append(START)
                seq.extend(map(numbers.__getitem__, words))
                chars += 32 + len(text.as_py() or "")
                if chars >= BATCH_CHARS:
                    yield filed()
                    ids, lengths, seq, numbers, chars, done = [], [], array("I"), _Numbers(), 0, done + 1
        if ids:
            yield filed()

    return written(narrow.mapInArrow(file, f"batch long, ids array<{kind}>, lengths array<long>, words array<long>, seq binary"), "word-numbers")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document: id, n_tokens, target_loss, background_loss, score. labels: (id, good boolean)."""
    spark = docs.sparkSession
    made = batches_of(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")))
    good = labels.where(col(id_col).isNotNull() & F.col("good")).select(col(id_col).alias("id")).distinct()
    places = made.select("batch", F.posexplode(F.arrays_zip("ids", "lengths")).alias("at", "doc")).select("batch", "at", "doc.ids", "doc.lengths")
    marked = places.join(good, places["ids"] == good["id"]).groupBy("batch").agg(F.collect_list("at").alias("good"), F.sum("lengths").alias("n"))
    marked = written(marked, "labelled-places")
    sizes = made.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0, marked.agg(F.sum("n")).first()[0] or 0
    vocabulary = made.select(F.explode("words").alias("word")).distinct().count() - 1
    n_buckets = min(1 << 16, BUCKETS * partitions(spark))
    both = made.join(marked.select("batch", "good"), "batch", "left").select("batch", "ids", "words", "seq", "good")

    def row_of(batch: pa.RecordBatch, i: int) -> tuple[pa.Array, Grams, np.ndarray]:
        """(ids, grams, which documents are good) of a row of `both`."""
        ids = batch.column(1)[i].values
        grams = Grams(batch.column(2)[i].values.to_numpy(zero_copy_only=False), _read(batch.column(3)[i].as_py(), np.int32), n_buckets)
        is_good = np.zeros(len(ids), bool)
        is_good[batch.column(4)[i].as_py() or []] = True
        return ids, grams, is_good

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each batch and bucket: the keys, and their counts in all and in good documents."""
        def sent_by(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
            ids, grams, is_good = row_of(batch, i)
            n = grams.counts(np.ones(len(ids), bool)), grams.counts(is_good)
            low, high = grams.keys.astype("<u4"), (grams.keys >> np.uint64(32)).astype("<u2")
            cut = [(a, b) for a, b in zip([0, *grams.ends[:-1]], grams.ends, strict=True)]
            cols = [pa.array(grams.buckets), pa.array([batch.column(0)[i].as_py()] * len(cut), pa.int64()), pa.array([low[a:b].tobytes() + high[a:b].tobytes() for a, b in cut], pa.binary())]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array([_numbers(x[a:b]) for a, b in cut], pa.binary()) for x in n)], ["bucket", "batch", "keys", "n", "t"])

        for batch in batches:
            for i in range(batch.num_rows):
                yield sent_by(batch, i)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row that a bucket got, the sums over all rows of the bucket. Rows come by bucket."""
        held, bucket = [], None

        def answered() -> pa.RecordBatch:
            low, high = [np.frombuffer(k, "<u4", len(k) // 6) for _, k, _, _ in held], [np.frombuffer(k, "<u2", len(k) // 6, len(k) // 6 * 4) for _, k, _, _ in held]
            _, at = _distinct(np.concatenate(low).astype(np.int64) | np.concatenate(high).astype(np.int64) << 32)
            sums = [np.bincount(at, np.concatenate([_read(h[k]) for h in held])).astype(np.int64)[at] for k in (2, 3)]
            ends = np.cumsum([len(x) for x in low])[:-1]
            cols = [pa.array([bucket] * len(held), pa.int64()), pa.array([h[0] for h in held], pa.int64()), *(pa.array([_numbers(x) for x in np.split(s, ends)], pa.binary()) for s in sums)]
            return pa.RecordBatch.from_arrays(cols, ["bucket", "batch", "n", "t"])

        for batch in batches:
            for b, *row in (tuple(x.as_py() for x in r) for r in zip(*batch.columns, strict=True)):
                if b != bucket:
                    if held:
                        yield answered()
                    held, bucket = [], b
                held.append(row)
        if held:
            yield answered()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
            ids, grams, is_good = row_of(batch, i)
            answers, totals = batch.column(5)[i].values, []
            for name in ("t", "n"):
                total = np.zeros(len(grams.keys), np.int64)
                total[grams.order] = np.concatenate([_read(a.as_py()) for a in answers.field(name)])
                totals.append(total)
            tokens, loss = np.zeros(len(ids), np.int64), np.zeros((2, len(ids)))
            for first, end in grams.slices():
                seq, pair = grams.places(first, end)
                of, place = np.cumsum(seq == START) - 1, np.flatnonzero(seq != START)
                before, word, docs_ = seq[place - 1], seq[place], of[place]
                # What the place's own document counts, of the word, of the word before it, and of both.
                own_word = _own(of, seq)
                own = own_word[place - 1], own_word[place], _own(docs_, pair)
                tokens[first:end] = length = np.bincount(docs_, minlength=end - first)
                for row, (total, size) in enumerate(zip(totals, reversed(sizes), strict=True)):
                    out = 1 if row else is_good[first:end][docs_].astype(np.int64)
                    v, w, vw = total[before] - out * own[0], total[word] - out * own[1], total[grams.width :][pair] - out * own[2]
                    p = (w + 1.0) / (size - out * length[docs_] + vocabulary)
                    loss[row, first:end] = np.bincount(docs_, -np.log((vw + MU * p) / (v + MU)), end - first)
            mean = loss / np.maximum(tokens, 1)
            cols = [pa.array(tokens, pa.int64()), *(pa.array(m, pa.float64(), mask=tokens == 0) for m in mean), pa.array(mean[0] - mean[1])]
            return pa.RecordBatch.from_arrays([ids, *cols], names)

        for batch in batches:
            for i in range(batch.num_rows):
                yield judged(batch, i)

    sent = both.mapInArrow(send, "bucket long, batch long, keys binary, n binary, t binary")
    sums = sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "bucket long, batch long, n binary, t binary")
    answers = sums.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "t"))).alias("answers"))  # one from each bucket
    names = ["n_tokens", "target_loss", "background_loss", "score"]
    names = [id_name(id_col, names), *names]
    kind = made.schema["ids"].dataType.elementType.simpleString()
    return both.join(answers, "batch").mapInArrow(judge, f"`{names[0]}` {kind}, n_tokens long, target_loss double, background_loss double, score double")
