import re

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import simhash


@pytest.fixture
def sf(spark, tmp_path):
    words = [f"w{i}" for i in range(300)]
    import random

    r = random.Random(9)
    base = [" ".join(r.choices(words, k=80)) for _ in range(20)]
    near = base[4].replace("w1", "w2", 1)
    texts = [*base, base[0], base[0].upper(), base[2] * 2, near, "123 456", None, "", "!!!"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), texts


def test_stages_equal_a_plain_run(spark, sf):
    path, texts = sf
    docs = [(i, t) for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    last = {re.sub("[A-Z]", lambda m: m[0].lower(), t): i for i, t in docs}
    docs = [(i, t) for i, t in docs if i in last.values()]
    prints, kept = {i: simhash.simhash(t) for i, t in docs}, []
    root = {i: i for i, _ in docs}
    for a, _ in docs:
        for b, _ in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                root[b] = min(root[b], root[a])
    kept = sorted(i for i in root if root[i] == i)
    got = corpus_pipeline.run(spark, path)
    assert sorted({r.doc_id for r in got.collect()}) == kept
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "packing"]


def test_stages_take_empty_tables(spark, sf):
    path, _ = sf
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_stages_take_odd_rows_and_names(spark, tmp_path):
    """Long texts, repeated and null ids, nulls, ties and columns named like the operators' own."""
    long_ = " ".join(f"word{i}" for i in range(30_000))
    rows = [(1, long_), (2, long_ + " end"), (3, "zz" * 200_000), (4, "some plain words here"), (4, "some plain words here"), (4, "other words of one id"), (None, "an id is missing"), (None, None), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "lang_pred", "key", "node", "c0", "c1", "ids", "bucket", "__tw_fp", "__tw_key", "a.b"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = sorted((str(r.doc_id), (r.text or "")[:5]) for r in docs.collect())
    assert kept == [("1", "word0"), ("3", "zzzzz"), ("4", "other"), ("4", "some "), ("None", "an id")]
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in got} == {1, 3, 4, None}
