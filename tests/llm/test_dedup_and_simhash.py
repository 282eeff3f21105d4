import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import exact_dedup, simhash
from tidewell.llm.components import components, lookup

SCHEMA = "doc_id long, text string, lang string, key string, kept string, __tw_x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", "c", "x") for i, t in rows], SCHEMA)


def rows():
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(words, k=r.randint(30, 90))) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[3].upper()) for i in range(30)]
    for i in range(30):
        w = base[5].split() * 3
        w[r.randrange(len(w))] = "changed"
        out.append((200 + i, " ".join(w)))
    return [*out, (300, None), (301, ""), (302, " \t\n"), (None, base[1]), (None, None), (7, base[7]), (303, "one"), (304, "ONE two"), (305, "É"), (306, "é"), (307, "long " * 20000)]


def test_exact_labels_match_brute_force(spark):
    data = rows()
    got = exact_dedup.label(frame(spark, data)).collect()
    norm = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = {}
    for i, t in data:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in data:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)  # of each group one row stays, repeated rows included
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_columns_and_empty_tables(spark):
    df = frame(spark, rows())
    kept = exact_dedup.dedup(df)
    assert kept.columns == df.columns
    assert kept.count() == len({re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for _, t in rows()})
    assert exact_dedup.dedup(df.limit(0)).count() == exact_dedup.label(df.limit(0)).count() == 0


def test_index_buckets_split_and_hold_distinct_texts(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 400).alias("text"))
    got = [r for r in exact_dedup.index(df, capacity=4).collect() if r.number is None]
    assert len(got) == 400
    buckets = {}
    for r in got:
        assert f"{xxhash.xxh64_intdigest(r.c2.encode()):064b}".startswith(r.bucket)
        buckets.setdefault(r.bucket, []).append(r)
    assert max(map(len, buckets.values())) <= 4
    assert not any(a != b and b.startswith(a) for a in buckets for b in buckets)


def test_the_answer_comes_out_of_the_directory(spark, monkeypatch):
    class Lost(exact_dedup.Directory):
        def find(self, key, data):
            return None  # a directory that finds nothing

    df = frame(spark, [(i, f"text {i % 5}") for i in range(40)]).repartition(8)
    assert exact_dedup.dedup(df).count() == 5
    monkeypatch.setattr(exact_dedup, "Directory", Lost)
    assert exact_dedup.dedup(df).count() > 5


def test_texts_with_one_key_are_chained_and_told_apart_by_bytes(spark, monkeypatch):
    class Constant:
        xxh64_intdigest = staticmethod(lambda data: 5 if len(data) % 2 else 2**63)

    monkeypatch.setattr(exact_dedup, "xxhash", Constant)
    data = [(i, f"text {i % 25}") for i in range(90)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.label(frame(spark, data).repartition(6)).collect()}
    for i, t in data:
        ids = [j for j, u in data if u == t]
        assert got[i] == (max(ids), len(ids), i == max(ids))


def test_labels_of_names_that_clash(spark):
    names = ["key", "place", "ids", "number", "stays", "count", "c1", "c0", "bucket", "a.b", "__tw_key", "__tw_sha"]
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(9)], "doc_id long, text string").withColumns({n: F.col("doc_id") for n in names})
    out = exact_dedup.dedup(df)
    assert out.schema == df.schema and sorted(tuple(r) for r in out.collect()) == [(i, f"t{i % 3}", *[i] * len(names)) for i in (6, 7, 8)]
    assert exact_dedup.label(df.select("key", F.col("text").alias("count")), "key", "count").where("kept").count() == 3


def test_directory_doubles_and_chains_equal_keys():
    d = exact_dedup.Directory(0, capacity=2)
    done = []
    keys = sorted([1, 1, 1, 2**63, 2**63 + 1, 2**62, 5 << 60, 6 << 60])
    for i, k in enumerate(keys):
        data = b"%d" % i
        assert d.find(k, data) is None
        done += d.closed(k)
        d.insert(exact_dedup.Entry(k, data, 0, i, None, [i], 0))
        assert d.find(k, data).best == i and all(d.find(k, b"%d" % j) is None for j in range(i + 1, 9))
    done += d.closed(None)
    assert [e.key for b in done for c in b.chains.values() for e in c] == keys
    assert [e.place for b in done for e in b.chains.get(1, [])] == [0, 1, 2]
    assert d.depth > 1 and all(len(b.chains) <= 2 for b in done)


def brute(data, shingle=4, radius=4):
    prints = []
    for i, t in data:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        s = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least.setdefault(find(k), []).append(i)
    return [(i, f"{p:016x}", min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, p) in enumerate(prints)], len(least)


def test_simhash_matches_brute_force(spark):
    data = [x for x in rows() if x[0] != 307]
    want, n = brute(data)
    got = [tuple(r) for r in simhash.near_duplicates(frame(spark, data)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.keep_one(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    assert kept.count() == n
    assert simhash.keep_one(frame(spark, [])).count() == simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [100, 10**6, 10**9])
def test_every_plan_of_segments_finds_all_links(spark, monkeypatch, n):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << bit
            fps.add(x)
    plan = simhash.segments(n)
    monkeypatch.setattr(simhash, "segments", lambda *_: plan)
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], f"{simhash.FP} long")
    got = {r[0]: r[1] for r in simhash.link_components(df).collect()}
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {x: find(x) for x in signed}


def test_plans_grow_with_the_corpus():
    assert len(simhash.segments(10**10)) == 2
    assert all(sum(w for _, w, _ in simhash.segments(n)) <= 64 for n in (0, 10, 10**5, 10**10))


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (102, 102), (60, 59), (60, 61)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100, 59: 59, 60: 59, 61: 59}


def test_lookup_with_hot_keys(spark):
    """A key with most of the rows, common ones, one that the table lacks."""
    rows = spark.range(6000).selectExpr("CASE WHEN id < 4000 THEN 7 ELSE id % 100 + 10 END AS k", "id")
    table = rows.where("k <> 11").groupBy("k").count().selectExpr("k", "count AS weight", "k * 2 AS top")
    got = {(r.k, r.id): r.top for r in lookup(rows, table, "k", 6000).collect()}
    assert got == {(r.k, r.id): None if r.k == 11 else r.k * 2 for r in rows.collect()}
