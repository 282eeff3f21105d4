"""Substring dedup by recompression.

A window is so many consecutive words of a text. A word goes if a window covers it whose words also start anywhere else,
in another text or the same. Windows are judged on the input, not on what is left.

Every text is recompressed level by level: runs of a word and pairs of adjacent symbols become symbols of the next level
(`recompress.py`). Names are hashes of what they stand for, so they are global without a table of names: a table would
shuffle every word on every level. Equal windows have the same interior on each level whatever stands around them, so a
window is known by its anchor, an interior symbol of the highest level that has one. Then, in Spark rounds:

1. Anchors are counted by name over the whole table. A window whose anchor stands nowhere else is unique. That is most of
   a corpus, and windows that follow each other share anchors, so that some 13 rows are shuffled for 100 words.
2. Windows whose anchors are shared are counted by a name of their whole sequence, a tree of pairs in 96 bits. Of 10^13
   windows the chance that any two names agree by accident is below one in a thousand.
3. What was found once is known from its own count: (row, place) of a name that came once is carried beside the count, so
   no name is ever joined back to its places. Windows that are left are repeated.

Rows are first written as a table bucketed by their number, so that texts are shuffled once for the three passes; what
the rounds find meets them there. Passes split and name words anew, which costs less than to keep them.

Skew: names are counted in each task before the shuffle, and nothing is grouped by a passage: a passage that a third of
all documents share is one row a task. Lists are of places within one text, no longer than it.

Cases: null and empty texts have no words; texts shorter than a window lose none. Rows are told apart by a number of
their own: repeated ids and repeated rows are rows like others (and copies). Null ids stay null. A very long text is
worked on by itself. An empty table gives an empty result; other columns are ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recompress
from .common import bucketed, col, id_name, written

WINDOW = 35
#: Words that are worked on at once.
AT_ONCE = 200_000


class _Turn:
    """Some texts of a batch in arrays: their words, windows and anchors."""

    def __init__(self, rows: list[tuple], window: int):
        self.rows = rows
        self.ends = list(accumulate(len(r[0]) for r in rows))
        self.starts = np.array([0, *self.ends[:-1]])
        self.lanes = recompress.word_names([w for r in rows for w in r[0]])
        self.text = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        self.start, self.at, self.symbol = recompress.anchors(self.lanes[0], self.text, window)
        self.first = recompress.occurrences(self.at, self.symbol)

    def marked(self, column: int) -> np.ndarray:
        """For each word: whether a column of the rows lists its place."""
        out = np.zeros(len(self.text), bool)
        for begin, row in zip(self.starts, self.rows, strict=True):
            if row[column] is not None and len(row[column]):
                out[begin + row[column]] = True
        return out

    def shared(self, column: int) -> np.ndarray:
        """Of the windows, those whose anchor's first window isn't in a column of the rows."""
        return np.repeat(~self.marked(column)[self.start[self.first]], np.diff(self.first, append=len(self.start)))

    def placed(self, start: np.ndarray) -> list[pa.Array]:
        """The number of the row and the place there of each window."""
        text = self.text[start]
        return [pa.array(np.array([r[1] for r in self.rows], np.int64)[text]), pa.array((start - self.starts[text]).astype(np.int32))]


def _turns(batch: pa.RecordBatch, window: int) -> Iterator[_Turn]:
    """batch: text, row, and further columns, of which lists come as arrays."""
    columns = [[None if not x.is_valid else x.values.to_numpy() for x in c] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns[1:]]
    words = (recompress.words_of(x.as_py()) for x in batch.column(0))
    return (_Turn(rows, window) for rows in recompress.chunks(zip(words, *columns, strict=True), AT_ONCE))


def _once(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows: (names..., row, place). -> (row, places) of the names that come once."""
    found = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("place").alias("place"))
    return found.where("n = 1").groupBy("row").agg(F.collect_list("place").alias("places"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a document: id, n_words, n_removed, removed (spans of words, each from `start` to before `end`) and kept (the
    words that stay, joined by one space)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    rows = bucketed(rows, "row", "texts")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _turns(batch, window):
                yield pa.RecordBatch.from_arrays([pa.array(t.symbol[t.first].view(np.int64)), *t.placed(t.start[t.first])], ["symbol", "row", "place"])

    unique = _once(rows.select("text", "row").mapInArrow(anchors, "symbol long, row long, place int"), ["symbol"])
    unique = written(unique.withColumnRenamed("places", "unique"), "unique-anchors")
    known = rows.join(unique, "row", "left")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _turns(batch, window):
                start = t.start[t.shared(2)]
                if len(start):
                    a, b = recompress.window_names(t.lanes, window)
                    yield pa.RecordBatch.from_arrays([pa.array(a[start].view(np.int64)), pa.array(b[start].astype(np.uint32).view(np.int32)), *t.placed(start)], ["a", "b", "row", "place"])

    alone = _once(known.select("text", "row", "unique").mapInArrow(windows, "a long, b int, row long, place int"), ["a", "b"])
    alone = written(alone.withColumnRenamed("places", "alone"), "unique-windows")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _turns(batch, window):
                start = t.start[t.shared(2) & ~t.marked(3)[t.start]]
                edges = np.zeros(len(t.text) + 1, np.int64)
                edges[start] += 1
                np.subtract.at(edges, start + window, 1)
                gone = np.cumsum(edges[:-1]) > 0
                n, removed, spans, kept, ids = [], [], [], [], []
                for begin, end, row in zip(t.starts, t.ends, t.rows, strict=True):
                    out = gone[begin:end]
                    at = np.flatnonzero(np.diff(out, prepend=False, append=False)).reshape(-1, 2)
                    n.append(len(out)), removed.append(int(out.sum())), ids.append(row[4])
                    spans.append([{"start": int(s), "end": int(e)} for s, e in at])
                    stay = row[0] if not len(at) else [w for s, e in zip([0, *at[:, 1]], [*at[:, 0], len(out)], strict=True) for w in row[0][s:e]]
                    kept.append(b" ".join(stay).decode())
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(4).type), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "removed", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    out = known.join(alone, "row", "left").select("text", "row", "unique", "alone", "id").mapInArrow(keep, f"id {kind}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")
    return out.withColumnRenamed("id", id_name(id_col, ["n_words", "n_removed", "removed", "kept"]))
