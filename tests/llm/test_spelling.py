"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from tidewell.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, slips=97, chars=5, least=3, ratio=2):
    n = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if slips and h % slips == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= chars and k >= least}
    forms, counts = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        counts[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n[w], counts[w], n.get(forms[w])))
    return out


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "word", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = [tuple(r) for r in spelling.variants(df, **more).collect()]
    slips, chars, least = (more.get(k, d) for k, d in (("slips", 97), ("least_chars", 5), ("least_count", 3)))
    assert len(got) == len(set(got)) and set(got) == brute(rows, slips, chars, least)
    return {r[0]: r for r in got}


def test_variants_match_all_pairs(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join("".join(rnd.choices("abÉé", k=rnd.randint(2, 7))) for _ in range(300))) for i in range(30)]
    rows += [(None, "aaaaab AAAAAB aaaaab"), (3, None), (4, ""), (5, "×÷×÷×÷ ×÷×÷×÷ ×÷×÷×÷ 1 2, 3"), rows[0], rows[0], (7, "ab" * 3000 + " " + "aabba " * 5000)]
    got = check(spark, rows)
    assert len(got) > 300 and any(r[1] for r in got.values())
    check(spark, rows[:8], slips=3)
    check(spark, rows[:8], slips=0, least_chars=1, least_count=1)
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chains_of_forms(spark):
    # Each word is near the next only, and half as frequent.
    words = ["abcdefgh"]
    for i in range(8):
        words.append(words[-1][:i] + "z" + words[-1][i + 1 :])
    rows = [(i, f"{w} " * (3 << i)) for i, w in enumerate(words)]
    got = check(spark, rows, slips=0)
    assert {r[2] for r in got.values()} == {words[-1]}


def test_groups_count_members_not_pairs(spark, monkeypatch):
    words = [f"prefix{chr(0xE0 + i)}suffix" for i in range(23)]
    df = spark.createDataFrame([(1, " ".join(w for w in words for _ in range(3)))], "doc_id long, text string")
    vocabulary = spelling.vocabulary(df, slips=0)
    by = {r["word"]: r for r in spelling.near(vocabulary).collect()}
    assert {r["n_near"] for r in by.values()} == {22} and by[words[0]]["top"] == words[1] and by[words[5]]["top"] == words[0]
