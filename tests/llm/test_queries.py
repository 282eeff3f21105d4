"""The queries that SQL can't express against brute force, over the whole smallest tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_dedup_and_simhash import brute
from tidewell.llm import lm_score, multiset_fp, queries
from tidewell.llm.common import table

DIR = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(table(spark, DIR, "documents").collect(), key=lambda r: r.doc_id)


@pytest.fixture(scope="module")
def ids(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation(), t.no_padding()
    got = [e.ids for e in t.encode_batch([r.text or "" for r in docs], add_special_tokens=False)]
    return {r.doc_id: (x, t.decode(x, skip_special_tokens=False)) for r, x in zip(docs, got)}


def run(spark, name):
    return queries.queries()[name](spark, DIR).collect()


def test_op4(spark, docs):
    want, _ = brute([(r.doc_id, r.text) for r in docs])
    assert sorted(tuple(r) for r in run(spark, "op4_simhash")) == sorted(want)


def plain_scores(docs, good):
    """{place: (n_tokens, target loss, background loss)} of documents (id, text), each scored by counts of the others."""
    laid = [["<s>", *lm_score.words_of(t)] for _, t in docs]
    size = len({w for ws in laid for w in ws[1:]})
    models = []
    for chosen in ([i in good for i, _ in docs], [True] * len(docs)):
        uni, bi = Counter(), Counter()
        for ws, c in zip(laid, chosen):
            if c:
                uni.update(ws), bi.update(zip(ws, ws[1:]))
        models.append((chosen, uni, bi, sum(n for w, n in uni.items() if w != "<s>")))
    out = []
    for k, ws in enumerate(laid):
        own, pairs, losses = Counter(ws), Counter(zip(ws, ws[1:])), []
        for chosen, uni, bi, n in models:
            less, n = (1, n - len(ws) + 1) if chosen[k] else (0, n)
            loss = 0.0
            for (a, b), c in pairs.items():
                p = (uni[b] - less * own[b] + 1) / (n + size)
                loss -= c * math.log((bi[a, b] - less * c + lm_score.MU * p) / (uni[a] - less * own[a] + lm_score.MU))
            losses.append(loss / (len(ws) - 1) if len(ws) > 1 else None)
        out.append((len(ws) - 1, *losses))
    return out


def test_op5(spark, docs):
    good = {r.doc_id for r in table(spark, DIR, "labels").collect() if r.quality == 1 and r.toxic == 0}
    want = plain_scores([(r.doc_id, r.text) for r in docs], good)
    got = {r.doc_id: r for r in run(spark, "op5_lm_score")}
    assert len(got) == len(docs)
    for r, (n, t, b) in zip(docs, want):
        g = got[r.doc_id]
        assert g.n_tokens == n
        if n:
            assert (g.target_loss, g.background_loss) == pytest.approx((t, b)) and g.score == pytest.approx(t - b, abs=1e-9)


def plain_fingerprint(text):
    """(lanes modulo 2^16, signed feature counts) with plain integers, paragraph by paragraph."""
    dense, profile = [0] * multiset_fp.DENSE, [0] * multiset_fp.PROFILE
    for line in text.encode().split(b"\n"):
        lanes = hashlib.shake_128(line).digest(2 * len(dense))
        dense = [(d + int.from_bytes(lanes[2 * i : 2 * i + 2], "little")) % 2**16 for i, d in enumerate(dense)]
        starts = [i for i in range(len(line)) if line[i] != 32 and (i == 0 or line[i - 1] == 32)] + [*range(0, len(line), 32)]
        for i in starts:
            low, high = (int.from_bytes(line[i + k : i + k + 8], "little") for k in (0, 8))
            h = (low * 0x9E3779B97F4A7C15 ^ high * 0xC2B2AE3D27D4EB4F) % 2**64
            h = (h ^ h >> 29) * 0xC2B2AE3D27D4EB4F % 2**64
            profile[h >> 58] += 2 * (h >> 57 & 1) - 1
    return dense, profile


def plain_likeness(a, b):
    if a == b:
        return 1.0
    dot = lambda x, y: sum(i * j for i, j in zip(x, y))
    norm = math.sqrt(dot(a[1], a[1]) * dot(b[1], b[1]))
    return min(1.0, max(0.0, dot(a[1], b[1]) / norm)) if norm else 0.0


def test_op6(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op6_multiset_fingerprint")}
    assert len(got) == len(docs)
    shown = lambda fp: b"".join([x.to_bytes(2, "little") for x in fp[0]] + [(x % 2**32).to_bytes(4, "little") for x in fp[1]]).hex()
    for r, following in zip(docs, docs[1:] + docs[:1]):
        text, n = r.text or "", following.text or ""
        k = len(text) // 4
        new = text[: len(text) - k] + n[:k]
        own, changed, other = (plain_fingerprint(x) for x in (text, new, n))
        assert tuple(got[r.doc_id])[:5] == (r.doc_id, len(text), sha(new), shown(own), shown(changed))
        assert tuple(got[r.doc_id])[5:] == pytest.approx((plain_likeness(own, changed), plain_likeness(own, other)))
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95


def test_op6_over_many_partitions(spark, docs):
    want = {tuple(r) for r in run(spark, "op6_multiset_fingerprint")}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        assert {tuple(r) for r in run(spark, "op6_multiset_fingerprint")} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_op8(spark, docs, ids):
    got = {r.doc_id: r for r in run(spark, "op8_bpe_codec")}
    for r in docs:
        x, said = ids[r.doc_id]
        assert tuple(got[r.doc_id]) == (r.doc_id, len(x), sha(" ".join(map(str, x))), sha(said))


def test_op9(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op9_language_id")}
    assert len(got) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert {r.doc_id for r in held} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    for r in docs:
        assert (got[r.doc_id].lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= got[r.doc_id].score <= 1


def test_op10(spark, docs, ids):
    want = set()
    for r in docs:
        x, at = [*ids[r.doc_id][0], 2], 0
        # Binary digits, longest first; what is beyond 4096 in pieces of 4096.
        for n in [4096] * (len(x) // 4096) + [1 << b for b in range(11, -1, -1) if len(x) % 4096 >> b & 1]:
            want.add((r.doc_id, at, n, zlib.crc32(np.array(x[at : at + n], "<u4").tobytes()), len(x), 0))
            at += n
        assert at == len(x)
    got = run(spark, "op10_packing")
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in got} == want
    assert len(got) == len(want) == len({r.sequence_id for r in got})
