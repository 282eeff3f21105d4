import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import lang_id, queries
from tidewell.llm.common import table

DIR = "/root/testdata/sf0.001"


def plain(samples: dict[str, list[str]], text: str | None) -> tuple[str, float]:
    """Greedy longest phrases by substring search."""
    clean = lambda t: " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
    text = clean(text)
    if not text:
        return "und", 0.0
    costs = []
    for lang, texts in sorted(samples.items()):
        known = "\0".join(map(clean, texts))
        n, i, unknown = 0, 0, 0
        while i < len(text):
            j, at = i + 1, known.find(text[i])
            unknown += at < 0
            while 0 <= at and j < len(text) and (at := known.find(text[i : j + 1], at)) >= 0:
                j += 1
            n, i = n + 1, j
        costs.append((n * math.log2(2 + sum(len(clean(t)) for t in texts)) + unknown * math.log2(0x110000), lang))
    (least, lang), *rest = sorted(costs)
    return lang, 1 - least / rest[0][0] if rest else None


def test_phrases_equal_a_plain_parse():
    samples = {"a": ["abracadabra abrakadabra", "cab"], "b": ["mississippi miss", "ssip"]}
    model = lang_id.fit([(lang, t) for lang, ts in samples.items() for t in ts])
    for text in ("abra miss kadabra", "ssippi", "zz abra", "m" * 300, "abracab", "ABRA\n\n12 cad", "", None, "12"):
        lang, score = model.predict(text)
        want = plain(samples, text)
        assert lang == want[0] and score == pytest.approx(max(0, want[1]))


def test_automata_hold_all_substrings_and_no_others():
    r = random.Random(3)
    texts = ["".join(r.choices("abc ", k=r.randint(0, 40))) for _ in range(30)]
    states = lang_id.automaton(texts)
    for k in range(1, 8):
        for _ in range(400):
            s, at = "".join(r.choices("abc ", k=k)), 0
            for c in s:
                at = states[at].get(c, -1) if at >= 0 else -1
            assert (at >= 0) == any(s in t for t in texts)


def test_query_equals_a_plain_parse(spark):
    docs = table(spark, DIR, "documents")
    rows = docs.withColumn("h", F.xxhash64("doc_id")).collect()
    samples: dict[str, list[str]] = {}
    for lang in {r.lang for r in rows if r.lang}:
        own = [r for r in rows if r.lang == lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
        own = sorted(own, key=lambda r: (len(r.text) > lang_id.CHARS_PER_LANG, r.h))[: lang_id.DOCS_PER_LANG]
        left = lang_id.CHARS_PER_LANG
        for r in own:
            if len(r.text) <= left:
                left -= len(r.text)
                samples.setdefault(lang, []).append(r.text)
    got = {r.doc_id: r for r in queries.op9_language_id(spark, DIR).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if len(r.text or "") > 4000:  # too slow by substring search
            continue
        want = plain(samples, r.text)
        assert got[r.doc_id].lang_pred == want[0] and got[r.doc_id].score == pytest.approx(want[1])
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_scripts_with_many_letters_stay_apart(spark):
    r = random.Random(1)
    signs = {"en": "abcdefghijklmnopqrstuvwxyz", "zh": [chr(0x4E00 + i) for i in range(400)], "ko": [chr(0xAC00 + i) for i in range(400)]}
    text = lambda lang, k: "".join(r.choices(signs[lang], k=k))
    model = lang_id.fit([(lang, text(lang, 3000)) for lang in signs])
    for lang in signs:
        assert {model.predict(text(lang, 60))[0] for _ in range(20)} == {lang}
    assert model.predict("".join(signs["zh"][300:]))[0] == "zh"


def test_a_language_with_a_small_sample_is_found(spark):
    """Normalised: a tenth of the others' text is enough."""
    rows = table(spark, "/root/testdata/sf0.01", "documents").where("lang IS NOT NULL AND length(text) BETWEEN 200 AND 4000").orderBy("doc_id").collect()
    by = {lang: [r.text for r in rows if r.lang == lang] for lang in ("de", "en", "fr")}
    model = lang_id.fit([(lang, t) for lang, texts in by.items() for t in texts[: 1 if lang == "de" else 15]])
    tests = by["de"][20:60]
    assert sum(model.predict(t)[0] == "de" for t in tests) >= 0.95 * len(tests)


def test_long_texts_are_learned_and_parsed_whole(spark):
    assert len(lang_id.fit([("a", "ab" * 5), ("b", "x" * 50_000)]).states[1]) == 50_001
    # The one long text of a language is learned whole though it exceeds the bound; the others must fit into it.
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1][:4]
    rows = [("long" * 50, "l"), ("ab cd", "s"), ("ef", "s"), ("gh ij" * 9, "s")]
    df = spark.createDataFrame([(i, *r) for i, r in zip(ids, rows)], "doc_id long, text string, lang string")
    model = lang_id.train(df, chars_per_lang=10)
    assert model.langs == ["l", "s"] and len(model.states[0]) == 201
    assert {c for s in model.states[1] for c in s} == set("ab cdef")
    end = "zwölf boxkämpfer " * 9000
    model = lang_id.fit([("de", "zwölf boxkämpfer "), ("en", "some other words")])
    assert model.predict("some other words " * 3 + end)[0] == "de"


def test_odd_tables(spark):
    model = lang_id.fit([("de", "der die das und"), ("en", "the and of that")])
    data = [(1, None, "x", "p"), (2, "", "x", "p"), (3, "12 !?", "x", "p"), (4, "日本", "x", "p"), (None, "the and of", "x", "p"), (None, "the and of", "x", "p"), (5, "a" * 300000, "x", "p")]
    odd = spark.createDataFrame(data, "doc_id long, text string, score string, Lang_Pred string")
    out = lang_id.identify(odd, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = out.select("lang_pred", "score").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and {r.lang_pred for r in got[4:6]} == {"en"} and all(0 <= r.score <= 1 for r in got)
    named = odd.withColumnsRenamed({"text": "a.b", "doc_id": "c0"})
    assert [r.lang_pred for r in lang_id.identify(named, model, text_col="a.b").collect()] == [r.lang_pred for r in got]
    assert lang_id.identify(odd.limit(0), model).count() == 0 and lang_id.keep_identified(odd, model).columns == odd.columns
    assert lang_id.keep_identified(odd, model).count() == 4
    none = lang_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in lang_id.identify(odd, none).collect()} == {"und"}


def test_documents_stay_where_no_language_is_labelled(spark):
    texts = ["some words", "日本", None, "", "12 !?"]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_known_language(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [0, 1]


def test_pieces_equal_a_letterwise_parse(monkeypatch):
    """Texts parsed in pieces side by side cost what a parse letter by letter says, whatever the pieces; so do automata without tables."""
    r = random.Random(5)
    for alphabet in ("a", "ab", "abc ", "abcdefgh ", "日本語 ab"):
        model = lang_id.fit([("x", "".join(r.choices(alphabet, k=300))), ("y", "".join(r.choices(alphabet, k=2000))), ("z", "a")])
        texts = [t for t in (lang_id.letters_of("".join(r.choices(alphabet + "zж", k=r.randint(1, 2000)))) for _ in range(100)) if t] + ["a", "z", "a" * 3000]
        want = [model.costs(t) for t in texts]
        for segment in (1, 2, 7, 256):
            monkeypatch.setattr(lang_id, "SEGMENT", segment)
            assert model.costs_of(texts) .tolist() == [pytest.approx(w) for w in want]
        for at_once in (1, 10_000):
            monkeypatch.setattr(lang_id, "AT_ONCE", at_once)
            assert model.predict_all([None, *texts, "", "12"])[1:-2] == [model.predict(t) for t in texts]
        monkeypatch.setattr(lang_id, "LARGEST", 1)
        assert lang_id.Model(model.langs, model.states, model.bits).costs_of(texts).tolist() == [pytest.approx(w) for w in want]
        monkeypatch.undo()
