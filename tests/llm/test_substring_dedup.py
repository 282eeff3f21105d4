"""Removed words against a count of every window."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewell.llm import recompress, substring_dedup


def brute(texts, window):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if n[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, texts, window=substring_dedup.WINDOW, parts=3):
    df = spark.createDataFrame([(i, t, "q", 7) for i, t in enumerate(texts)], "doc_id long, text string, kept string, row int").repartition(parts)
    got = {r.doc_id: r for r in substring_dedup.dedup(df, window=window).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, window)):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept) == want, i
        words = re.findall("[^\x20\x09-\x0d]+", texts[i] or "")
        gone = [k for s in r.removed for k in range(s.start, s.end)]
        assert " ".join(w for k, w in enumerate(words) if k not in set(gone)) == r.kept and len(gone) == r.n_removed
    return got


def text(rnd, n, words=2000):
    return [f"w{rnd.randrange(words)}é" for _ in range(n)]


def test_passages_copies_and_odd_texts(spark):
    rnd = random.Random(3)
    passage, edge, short = text(rnd, 60), text(rnd, 35), text(rnd, 34)
    texts = [" ".join(text(rnd, rnd.randint(0, 300))) for _ in range(20)]
    for i in range(12):
        texts.append("\n ".join(text(rnd, i) + passage + text(rnd, 20) + (edge if i % 2 else short) + text(rnd, 5)))
    texts += [None, "", " \t\n\r\x0b\x0c ", " ".join(edge), " ".join(edge), " ".join(short), " ".join(short), "a b 　 \x1f x"]
    texts += ["a " * 34, "a " * 35, "a " * 36, "a b " * 200, "a a b " * 200, "a b a b a b c " * 30, "x " + "a " * 40 + "y"]
    texts += [" ".join(passage * 3), texts[2], texts[2], " ".join(text(rnd, 40_000, 50_000))]
    texts += [" ".join(x) for x in ([*passage[:50], "other", *passage[50:]], passage[:36], passage[20:], [*passage[:34], "z", *passage[35:]])]
    got = check(spark, texts)
    assert got[len(texts) - 3].n_removed == 36


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_small_alphabets_and_windows(spark, window):
    rnd = random.Random(window)
    texts = [" ".join(rnd.choices("abc", k=rnd.randint(0, 40))) for _ in range(60)]
    check(spark, texts, window)


def test_ids_and_empty_tables(spark):
    rows = [(None, "a b c " * 30), (1, "a b c " * 30), (1, "z"), (1, "z")]
    df = spark.createDataFrame(rows, "kept int, text string")
    got = substring_dedup.dedup(df, id_col="kept").collect()
    assert sorted((r.kept_id is None, r.n_words, r.n_removed) for r in got) == [(False, 1, 0), (False, 1, 0), (False, 90, 90), (True, 90, 90)]
    assert substring_dedup.dedup(df.limit(0), id_col="kept").count() == 0


def test_interiors_do_not_depend_on_what_stands_around():
    """Equal windows have equal anchors at equal places, by chance-free arrays: small alphabets, runs and periods."""
    rnd = np.random.default_rng(4)
    for alphabet in (1, 2, 3, 50):
        inner = rnd.integers(0, alphabet, 200)
        seen = {}
        for _ in range(20):
            names = np.concatenate([rnd.integers(0, alphabet, rnd.integers(0, 50)), inner, rnd.integers(0, alphabet, rnd.integers(0, 50))]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            start, at, symbol = recompress.anchors(names, np.zeros(len(names), int), 35)
            for s, a, y in zip(start.tolist(), at.tolist(), symbol.tolist(), strict=True):
                assert seen.setdefault(names[s : s + 35].tobytes(), (a - s, y)) == (a - s, y)


def test_anchors_tell_most_unique_windows_apart():
    rnd = np.random.default_rng(5)
    names = rnd.choice(rnd.integers(0, 2**64, 5000, np.uint64), 50_000, p=(w := 1 / np.arange(1, 5001)) / w.sum())
    start, at, symbol = recompress.anchors(names, np.zeros(len(names), int), 35)
    first = recompress.occurrences(at, symbol)
    assert len(first) < 0.2 * len(names)
    values, counts = np.unique(symbol[first], return_counts=True)
    assert counts[np.searchsorted(values, symbol)].mean() < 20 and (counts[np.searchsorted(values, symbol)] == 1).mean() > 0.5
