"""Language identification by cross-parsing.

A suffix automaton of some labelled text of each language holds all its substrings. A new text is cut greedily into
the longest phrases that a language's automaton knows. A phrase points into a sample of m characters, so it costs
log2(m) bits: phrases * log2(m) is the text's cross-entropy with the language, whatever the sizes of the samples. A sign
that the sample lacks is a phrase of its own and is spelt out besides. The language with the least bits wins.

The labelled text is a bounded sample of rows, whole texts each: of a language's documents the `docs_per_lang` with the
smallest hashed ids, texts up to `chars_per_lang` characters before longer ones, and of these as many as fit into
`chars_per_lang` together, the first in any case. New texts are parsed whole, and every letter stands for itself;
whatever lies between letters counts as one space.

Many texts are parsed together, in pieces of SEGMENT letters that take their steps side by side through tables of the
automata. A piece's own parse begins a phrase at its first letter, where the text's parse may be amid one: so from the
state in which the piece before ends it is parsed again, until both begin a phrase at the same letter, from where they
are one. That gives the plain parse's counts exactly. Automata too large for a table of LARGEST entries (states times
letters) are walked letter by letter.

Cases: a null text or one with no letter is `und` with score 0, and so is everything if no labelled text was found.
Ties go to the language that sorts first. Rows with a null id are never learned from (their remainder is unknown) and
are not held out. Repeated rows get equal answers. Other columns are kept as they are, but columns of the input named
like the results (in any case of letters) are replaced by them. An empty table gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, numbered

UND = "und"
#: Bits of a sign that a sample lacks, as it stands, beside those of its phrase.
SPELT = math.log2(0x110000)
DOCS_PER_LANG, CHARS_PER_LANG = 32, 32_000
#: Letters of a piece, letters that are parsed together, entries of a table.
SEGMENT, AT_ONCE, LARGEST = 256, 2_000_000, 1 << 25


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that are only predicted, never learned from."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 3 == 1, F.lit(False))


class _Letters(dict):
    """For str.translate: a letter is itself, anything else a space."""

    def __missing__(self, point: int) -> str:
        self[point] = out = chr(point) if chr(point).isalpha() else " "
        return out


_LETTERS = _Letters()


def letters_of(text: str | None) -> str:
    """Lower-cased words of letters with one space between; empty without letters."""
    return " ".join((text or "").lower().translate(_LETTERS).split())


def automaton(texts: list[str]) -> list[dict[str, int]]:
    """The transitions of each state of the suffix automaton of some texts; phrases don't run from one into the next."""
    nxt, link, length = [{}], [-1], [0]
    for text in texts:
        last = 0
        for c in text:
            if c in nxt[last]:  # known from an earlier text
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                cur, p = None, last
            else:
                cur, p = len(nxt), last
                nxt.append({}), link.append(0), length.append(length[last] + 1)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][c]
            if length[q] == length[p] + 1:
                last = link[cur] = q
            else:
                last = len(nxt)
                nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = last
                    p = link[p]
                link[q] = last
            if cur is not None:
                link[cur], last = last, cur
    return nxt


@dataclass
class Model:
    langs: list[str]
    states: list[list[dict[str, int]]]  # each language's automaton
    bits: list[float]  # what a phrase of each language costs

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "states": self.states, "bits": self.bits}

    @cached_property
    def roots(self) -> list[dict]:
        """The automata as dictionaries that hold the next ones."""
        out = []
        for states in self.states:
            made = [{} for _ in states]
            for own, go in zip(made, states, strict=True):
                own.update((c, made[to]) for c, to in go.items())
            out.append(made[0])
        return out

    def costs(self, letters: str) -> list[float]:
        """Bits of a text, not empty, in each language."""
        out, nowhere = [], {}
        for root, bits in zip(self.roots, self.bits, strict=True):
            state, phrases, unknown = nowhere, 0, 0
            for c in letters:
                to = state.get(c)
                if to is None:
                    phrases += 1
                    to = root.get(c)
                    if to is None:
                        unknown += 1
                        to = nowhere
                state = to
            out.append(phrases * bits + unknown * SPELT)
        return out

    @cached_property
    def codes(self) -> np.ndarray:
        """A number for each letter of the samples, by code point; the last one for all others."""
        letters = sorted({c for states in self.states for go in states for c in go})
        out = np.full(0x110000, len(letters), np.int32)
        out[[ord(c) for c in letters]] = np.arange(len(letters))
        return out

    @cached_property
    def tables(self) -> list[np.ndarray] | None:
        """Each automaton's transitions at state + code, where a state is its number times that of codes; -1 for none. The
        state behind the last one is nowhere, without any."""
        width = int(self.codes.max()) + 1
        if any((len(states) + 1) * width > LARGEST for states in self.states):
            return None
        out = []
        for states in self.states:
            table = np.full((len(states) + 1) * width, -1, np.int32)
            at, to = zip(*((i * width + self.codes[ord(c)], q * width) for i, go in enumerate(states) for c, q in go.items()), strict=True)
            table[list(at)] = to
            out.append(table)
        return out

    def costs_of(self, texts: list[str]) -> np.ndarray:
        """Bits of texts, none empty, in each language: a row a text."""
        if self.tables is None:
            return np.array([self.costs(t) for t in texts])
        sizes = np.array([len(t) for t in texts])
        codes = self.codes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        pieces = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(texts)), pieces)
        part = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(SEGMENT, sizes[text] - part * SEGMENT)
        order = np.argsort(-length, kind="stable")  # at each step the pieces that go on come first
        begin = (np.repeat(np.cumsum(sizes) - sizes, pieces) + part * SEGMENT)[order]
        lanes = np.searchsorted(-length[order], -np.arange(SEGMENT), "left")
        place = np.empty(len(text), np.int64)  # where the order has a piece
        place[order] = np.arange(len(text))
        steps = np.full((SEGMENT, len(text)), -1, np.int32)
        for k, n in enumerate(lanes):
            steps[k, :n] = codes[begin[:n] + k]
        before = np.where(part[order] > 0, place[np.maximum(order - 1, 0)], -1)
        out = np.empty((len(texts), len(self.langs)))
        for i, (table, bits) in enumerate(zip(self.tables, self.bits, strict=True)):
            phrases, unknown = self._phrases(table, steps, lanes, before)
            out[:, i] = np.bincount(text, phrases[place], len(texts)) * bits + np.bincount(text, unknown[place], len(texts)) * SPELT
        return out

    def _phrases(self, table: np.ndarray, steps: np.ndarray, lanes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that begin, and letters that the sample lacks, in each piece). before: the piece before each of the same
        text, -1 for none."""
        width = int(self.codes.max()) + 1
        nowhere = len(table) - width
        root = np.where(table[:width] < 0, nowhere, table[:width]).astype(np.int32)
        state = np.full(steps.shape[1], nowhere, np.int32)
        began = np.zeros(steps.shape, bool)
        unknown = np.zeros(steps.shape[1], np.int64)
        for k, n in enumerate(lanes):
            c = steps[k, :n]
            to = table[state[:n] + c]
            new = began[k, :n] = to < 0
            fresh = root[c]
            state[:n] = np.where(new, fresh, to)
            unknown[:n] += fresh == nowhere
        phrases = began.sum(axis=0)
        length = np.searchsorted(-lanes, -np.arange(steps.shape[1]), "left")  # of each piece
        # A piece whose end changes makes the next one be looked at again.
        entered, own_end = np.full(steps.shape[1], nowhere, np.int32), state.copy()
        now = np.flatnonzero(before >= 0)
        while len(now):
            now = now[state[before[now]] != entered[now]]
            if not len(now):
                break
            entered[now] = state[before[now]]
            lane, s, k = now, entered[now], 0
            count, own = np.zeros(len(now), np.int64), np.zeros(len(now), np.int64)
            at, total, end = np.arange(len(now)), began[:, now].sum(axis=0), own_end[now]
            while len(lane):
                on = length[lane] > k
                if not on.all():  # the piece is over before both meet
                    end[at[~on]] = s[~on]
                    lane, s, at = lane[on], s[on], at[on]
                    continue
                c = steps[k, lane]
                to = table[s + c]
                new, mine = to < 0, began[k, lane]
                s = np.where(new, root[c], to)
                count[at] += new
                own[at] += mine
                apart = ~(new & mine)
                lane, s, at, k = lane[apart], s[apart], at[apart], k + 1
            phrases[now] = total - own + count
            changed = now[end != state[now]]
            state[now] = end
            now = np.flatnonzero(np.isin(before, changed))
        return phrases, unknown

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, by how much the next one is dearer, 0 to 1)."""
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        letters = [letters_of(t) for t in texts]
        out = [(UND, 0.0)] * len(texts)
        if not self.langs:
            return out
        turn, n = [], 0
        for i, t in enumerate(letters):
            if t:
                turn.append(i)
                n += len(t)
            if turn and (n >= AT_ONCE or i == len(letters) - 1):
                for j, costs in zip(turn, self.costs_of([letters[j] for j in turn]).tolist(), strict=True):
                    out[j] = self._choice(costs, letters[j])
                turn, n = [], 0
        return out

    def _choice(self, costs: list[float], letters: str) -> tuple[str, float]:
        least = min(costs)
        best = costs.index(least)
        other = min(costs[:best] + costs[best + 1 :], default=len(letters) * SPELT)
        return self.langs[best], min(1.0, max(0.0, 1.0 - least / other))


def fit(samples: list[tuple[str, str]]) -> Model:
    """samples: (language, text)."""
    texts: dict[str, list[str]] = {}
    for lang, text in sorted(samples):
        if letters := letters_of(text):
            texts.setdefault(lang, []).append(letters)
    return Model(list(texts), [automaton(t) for t in texts.values()], [math.log2(2 + sum(map(len, t))) for t in texts.values()])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG, chars_per_lang: int = CHARS_PER_LANG) -> Model:
    """Fit on the bounded sample: rows are picked by narrow columns first, then their texts are read."""
    rows = docs.select(col(id_col).alias("id"), col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"), held_out(id_col).alias("held"))
    rows = rows.where("lang IS NOT NULL AND id IS NOT NULL AND text IS NOT NULL AND NOT held").withColumns({"chars": F.length("text"), "digest": F.xxhash64("text")})
    w = Window.partitionBy("lang").orderBy(F.col("chars") > chars_per_lang, F.xxhash64("id"), "id", "digest")
    first = rows.select("id", "lang", "chars", "digest").distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= docs_per_lang)
    picked, left = [], {}
    for r in sorted(first.collect(), key=lambda r: (r["lang"], r["rn"])):  # docs_per_lang rows a language at most
        room = left.get(r["lang"], max(chars_per_lang, r["chars"]))
        if r["chars"] <= room:
            picked.append((r["lang"], r["digest"]))
            left[r["lang"]] = room - r["chars"]
    if not picked:
        return fit([])
    texts = rows.where(F.col("digest").isin([d for _, d in picked])).groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return fit([(r["lang"], r["text"]) for r in texts.collect() if (r["lang"], r["digest"]) in picked])


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with pred_col and score_col (0 to 1: by what share the next language costs more) beside its columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name.lower() not in (pred_col.lower(), score_col.lower())]
    names = [*(f.name for f in fields), pred_col, score_col]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = sent.value.predict_all(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names)

    schema = T.StructType([*fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return numbered(docs, text_col, [f.name for f in fields]).mapInArrow(add, schema)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose language is found, with the columns of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([lang != UND for lang, _ in sent.value.predict_all(batch.column(0).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names).filter(found)

    return numbered(docs, text_col, names).mapInArrow(keep, docs.schema)
