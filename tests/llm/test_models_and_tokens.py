import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_queries import plain_scores
from tidewell.llm import bpe_codec, lm_score, multiset_fp, packing, simhash
from tidewell.llm.bpe import Encoder, read_spec, splices
from tidewell.llm.common import table

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tok():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation(), t.no_padding()
    return t


def odd_texts():
    r = random.Random(5)
    signs = [*"aB' s\n\t<|>endoftx\u0301éÉ1٣İΣςǅ\u200d🙂", "'ll", "<|endoftext|>", "the quick ", "ﬁ"]
    shared = " ".join(r.choices(["alpha", "beta", "gamma's", "Ünder", "12,5"], k=900))
    return [None, "", " \n ", "x" * 9000, *("".join(r.choices(signs, k=k)) for k in (1, 5, 40, 300) for _ in range(30)), shared, "head " + shared + " tail", shared.upper(), shared[7:] + shared, shared]


def test_encoder_equals_the_library(tok):
    enc = Encoder(read_spec())
    for t in odd_texts():
        assert np.frombuffer(enc.encode(t or ""), np.uint32).tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_other_tokenizers(spark, tmp_path):
    """Files with other rules: spliced where pieces tell, encoded whole where nothing is known of them."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    prefixed = json.loads(read_spec(path))
    prefixed["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "prefixed.json").write_text(json.dumps(prefixed))
    assert splices(read_spec()) and splices(read_spec(path)) and not splices(json.dumps(prefixed))
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for file in (path, str(tmp_path / "prefixed.json")):
        other, enc = Tokenizer.from_file(file), Encoder(read_spec(file))
        ids = [other.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(enc.encode(t or ""), np.uint32).tolist() for t in texts] == ids
        for r in bpe_codec.encode(df, tokenizer=file, with_ids=True).collect():
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id] and r.decoded_sha256 == sha(other.decode(ids[r.doc_id], skip_special_tokens=False))
    one = spark.createDataFrame([(1, "some words  here\n")], "doc_id long, text string")
    assert packing.pack(one, tokenizer=path).first().doc_tokens == len(Tokenizer.from_file(path).encode("some words  here\n").ids) + 1


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_joins_agree_or_are_given_up(file):
    """Units of texts cut anywhere join to the library's ids; where the sides don't agree, none are given."""
    import public_tokenizers

    enc, r, given_up = Encoder(read_spec(public_tokenizers.path(file))), random.Random(7), 0
    words = [[*"aB' s\n\tx\u0301é1٣İ🙂"], ["the ", "quick'", "s brown", "\u0301", "12", "!!", "<|endof", "text|>", "  "]]
    for k in (3, 40, 700):
        for signs in words * 60:
            text = "".join(r.choices(signs, k=k))
            want = enc.full.encode(text, add_special_tokens=False).ids
            assert b"".join(t for t, _ in enc.pieces(text)) == text.encode() and np.frombuffer(bpe_codec.ids_of(enc.pieces(text)), "<u4").tolist() == want
            at = sorted({0, len(text), *(r.randrange(len(text) + 1) for _ in range(4))})
            units = [bpe_codec.unit(enc, text[a:b].encode()) for a, b in zip(at, at[1:])]
            got = bpe_codec.joined(enc, units)
            given_up += got is None
            assert got is None or np.frombuffer(got, "<u4").tolist() == want
    assert given_up < 40 and bpe_codec.joined(enc, []) == b""
    plain = bpe_codec.unit(enc, b"some plain words of which there are many more than enough for a middle part between two edges, and so on")
    assert not isinstance(plain, bytes) and bpe_codec.unfolded(bpe_codec.folded(enc.pieces("a b  c"))) == enc.pieces("a b  c")
    wrong = (bpe_codec.folded([(t, b"\1\0\0\0") for t, _ in bpe_codec.unfolded(plain[0])]), *plain[1:])
    assert bpe_codec.joined(enc, [plain, wrong]) is None  # no piece of the window is the chunk's


def test_documents_without_agreement_are_encoded_whole(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = Encoder(read_spec(path))
    text = "".join(random.Random(24).choices(["<|end", "oftext|>", "'l"], k=6000))
    ends = bpe_codec.cuts(text.encode())
    assert bpe_codec.joined(enc, [bpe_codec.unit(enc, text.encode()[a:b]) for a, b in zip([0, *ends], ends)]) is None
    texts = [text, text + " z", "z " + text, text]  # all chunks are shared
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = bpe_codec.encode(df, tokenizer=path, with_ids=True).collect()
    assert len(got) == 4 and all(np.frombuffer(r.ids, "<u4").tolist() == enc.full.encode(texts[r.doc_id], add_special_tokens=False).ids for r in got)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "n_tokens long, text string")
    assert bpe_codec.encode(df, "n_tokens").columns[0] == "n_tokens_id"
    assert lm_score.score(df, spark.createDataFrame([], "n_tokens long, good boolean"), "n_tokens").columns[:2] == ["n_tokens_id", "n_tokens"]
    df = df.toDF("fingerprint", "text")
    assert multiset_fp.compare(df, "fingerprint").columns[0] == simhash.near_duplicates(df, "fingerprint").columns[0] == "fingerprint_id"


def test_codec_equals_the_library(spark, tok):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)] + [(None, "a b", "e"), (3, texts[3], "e")], "doc_id long, text string, key string").repartition(5)
    got = bpe_codec.encode(df, with_ids=True).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "a b" if r.doc_id is None else texts[r.doc_id] or ""
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
    assert bpe_codec.encode(df.limit(0)).count() == 0


def test_cuts_follow_content():
    r = random.Random(1)
    text = "".join(r.choices("abcdé fgh\n", k=60000)).encode()
    ends = bpe_codec.cuts(text)
    assert ends[-1] == len(text) and len(ends) > 20
    b"".join(text[a:b] for a, b in zip([0, *ends], ends)).decode()
    assert all(text[a:b].decode() is not None for a, b in zip([0, *ends], ends))
    moved = {e - 10 for e in bpe_codec.cuts(b"0123456789" + text)}
    assert len(moved & set(ends)) >= len(ends) - 2
    assert bpe_codec.cuts(b"") == []


def test_packing_covers_each_document_once(spark, tok, tmp_path):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1)], "doc_id long, text string, length int").repartition(3)
    got = packing.pack(df).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {None, *range(len(texts))}
    for i, rows in by.items():
        ids = [*tok.encode((texts[i] if i is not None else "") or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(part), part)
            assert r.length & (r.length - 1) == 0 and r.length <= 4096
            at += r.length
        assert at == len(ids)
    assert packing.pack(df.limit(0)).count() == 0
    # Batches hold sequences of one length, as many as fit; in a task only the last of a length may be short.
    small = packing.pack(df, batch_tokens=4096).collect()
    batches = {}
    for x in small:
        batches.setdefault(x.batch, []).append(x)
    assert all(len({x.length for x in b}) == 1 and sorted(x.batch_row for x in b) == list(range(len(b))) for b in batches.values())
    assert all(len(b) * b[0].length <= 4096 for b in batches.values()) and len(batches) < len(small)
    short = [(k >> 32, b[0].length) for k, b in batches.items() if (len(b) + 1) * b[0].length <= 4096]
    assert len(short) == len(set(short))
    packing.write_buckets(packing.pack(df), str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == len(got) and sorted({x.length for x in got}) == sorted(int(p.name.removeprefix("length=")) for p in (tmp_path / "b").glob("length=*"))
    assert packing.pack(df.select(F.col("doc_id").alias("start"), "text"), id_col="start").columns[:2] == ["start_id", "start"]
    assert packing.cuts(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1] and packing.cuts(0, 8) == []


def test_fingerprints_are_homomorphic_and_graded():
    r = random.Random(2)
    lines = [" ".join(r.choices([f"word{i}" for i in range(500)], k=20)) for _ in range(40)]
    fp = multiset_fp.fingerprint("\n".join(lines))
    mixed = lines[:]
    r.shuffle(mixed)
    assert multiset_fp.fingerprint("\n".join(mixed)) == fp
    assert multiset_fp.insert(multiset_fp.fingerprint("\n".join(lines[:30])), "\n".join(lines[30:])) == fp
    assert multiset_fp.delete(fp, "\n".join(lines[30:])) == multiset_fp.fingerprint("\n".join(lines[:30]))
    assert multiset_fp.fingerprint("\n".join([*lines, lines[0]])) != fp
    assert multiset_fp.likeness(fp, multiset_fp.fingerprint("\n".join(lines[:30]))) > 0.6
    assert multiset_fp.likeness(fp, multiset_fp.fingerprint("other text " * 50)) < 0.4
    assert multiset_fp.likeness(multiset_fp.fingerprint(None), fp) == 0


def test_neighbours_follow_ids(spark):
    r = random.Random(4)
    data = [(i * 3, r.choice([None, "", "é🙂" * 9, "some words\nand lines " * r.randint(1, 30)]), "x") for i in range(101)]
    df = spark.createDataFrame(data, "doc_id long, text string, fingerprint string")
    for frame, rows in ((df.repartition(7), data), (df.limit(1), data[:1]), (df.limit(0), [])):
        rows = sorted(rows)
        got = {r.doc_id: r for r in multiset_fp.compare(frame).collect()}
        assert len(got) == len(rows)
        for (i, t, _), (_, n, _) in zip(rows, rows[1:] + rows[:1]):
            t, n = t or "", n or ""
            k = len(t) // 4
            e = t[: len(t) - k] + n[:k]
            g = got[i]
            assert (g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint) == (len(t), sha(e), multiset_fp.fingerprint(t).hex(), multiset_fp.fingerprint(e).hex())
            assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "c"), (2, "d")], "doc_id long, text string")
    assert multiset_fp.compare(odd).count() == 5


def test_scores_equal_plain_counts(spark, monkeypatch):
    docs = [(1, "good words here"), (2, "good words again"), (3, "bad stuff here"), (4, None), (5, "!!!"), (3, "bad stuff here"), (None, "good"), (6, "so " * 50_000 + "Ünd"), (7, " \n")]
    good = {1, 2}
    labels = spark.createDataFrame([(1, True), (2, False), (2, True), (3, False), (None, True), (1, True)], "doc_id long, good boolean")
    df = spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, score int, batch int").repartition(3)
    key = lambda r: tuple((x is None, x) for x in r)
    for chars in (lm_score.BATCH_CHARS, 1):  # one batch a task, one a document
        monkeypatch.setattr(lm_score, "BATCH_CHARS", chars)
        for frame, marks, chosen in ((df, labels, good), (df, labels.limit(0), set())):
            want = sorted(((i, *w) for (i, _), w in zip(docs, plain_scores(docs, chosen))), key=key)
            got = lm_score.score(frame, marks).collect()
            assert all(r.score == pytest.approx(r.target_loss - r.background_loss) if r.n_tokens else r.score == 0 for r in got)
            for g, w in zip(sorted((tuple(r)[:4] for r in got), key=key), want, strict=True):
                assert g[:2] == w[:2] and (g[2:] == w[2:] == (None, None) or g[2:] == pytest.approx(w[2:]))
    assert lm_score.score(df.limit(0), labels).count() == 0


def test_labels_held_out_are_told_apart(spark):
    """Good documents are told from others, no better where their own label was used than where it wasn't."""
    dir_ = "/root/testdata/sf0.01"
    labels = table(spark, dir_, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    good = {r.doc_id: r.good for r in labels.collect()}
    used = F.col("doc_id") % 2 == 0
    got = {r.doc_id: r.score for r in lm_score.score(table(spark, dir_, "documents"), labels.where(used)).collect()}

    def auc(ids):
        yes, no = [got[i] for i in ids if good[i]], [got[i] for i in ids if not good[i]]
        return np.mean([(y < n) + (y == n) / 2 for y in yes for n in no])

    seen, held = (auc([i for i in good if i in got and i % 2 == k]) for k in (0, 1))
    print("AUC", seen, held)
    assert held > 0.7 and abs(seen - held) < 0.15


def test_lm_grams_take_little_memory(monkeypatch):
    """Numbers of a batch take under 50 bytes a token while its grams are made and counted; counts are those of all places."""
    rng = np.random.default_rng(0)
    lengths = [0, 1, 400_000, *rng.integers(0, 600, 2000).tolist(), 0]
    seq = np.concatenate([np.concatenate([[0], rng.zipf(1.3, n) % 50_000 + 1]) for n in lengths])
    words = rng.integers(-(2**62), 2**62, 50_001)
    tracemalloc.start()
    grams = lm_score.Grams(words, seq, 204)
    seen = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen < 50 * len(seq), seen / len(seq)
    monkeypatch.setattr(lm_score, "SLICE", 1000)
    runs = list(grams.slices())
    assert [a for a, _ in runs] == [0, *(b for _, b in runs[:-1])] and runs[-1][1] == len(lengths)
    assert all(b - a == 1 or sum(lengths[a:b]) + b - a <= 1000 for a, b in runs)
    docs = rng.random(len(lengths)) < 0.5
    picked = docs[np.cumsum(seq == 0) - 1]
    pairs, pair = np.unique((seq[:-1] << 32 | seq[1:])[seq[1:] != 0], return_inverse=True)
    want = np.concatenate([np.bincount(seq[picked], minlength=len(words)), np.bincount(pair[picked[1:][seq[1:] != 0]], minlength=len(pairs))])
    assert (grams.counts(docs) == want[grams.order]).all()
