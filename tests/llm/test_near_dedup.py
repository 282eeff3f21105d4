import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import components, near_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, __tw_k string"


def brute(data):
    """The smallest id of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, t in data:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(data):
        least.setdefault(find(k), []).append(i)
    return sorted(min((i for i in ids if i is not None), default=-1) for ids in least.values())


def changed(r, text, n):
    w = text.split()
    for at in r.sample(range(len(w)), n):
        w[at] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_stage_equals_exact_jaccard(spark):
    r = random.Random(3)
    base = [" ".join(r.choices([f"w{i}" for i in range(2000)], k=r.randint(60, 300))) for _ in range(40)]
    data = list(enumerate(base))
    for i, t in enumerate(base):
        data += [(1000 + 10 * i + n, changed(r, t, round(len(t.split()) * share))) for n, share in enumerate((0.01, 0.02, 0.03, 0.06))]
    for i in range(150):  # a chain and a large group
        data.append((2000 + i, changed(r, base[1], 2)))
    data += [(5000, None), (5001, ""), (5002, "one"), (5003, "ONE"), (5004, "one two"), (None, base[3]), (None, "no id"), (7, base[7])]
    distances = [(simhash.simhash(base[0], 5) ^ simhash.simhash(t, 5)).bit_count() for i, t in data if i in (1000, 1001)]
    assert max(distances) > 4  # beyond what the fingerprints of op4 link
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in data], SCHEMA).repartition(5)
    out = corpus_pipeline.drop_near_copies(spark, df, "")
    assert out.columns == df.columns
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in out.collect()) == brute(data)


def test_one_large_group_of_copies(spark):
    """Most pairs lie below the likeness, many above: the components are those of all pairs."""
    r = random.Random(4)
    base = " ".join(r.choices([f"w{i}" for i in range(3000)], k=150))
    data = [(i, changed(r, base, r.choice((1, 3, 6)))) for i in range(300)] + [(500, "other text")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    assert sorted(x.doc_id for x in near_dedup.keep_one(df).collect()) == brute(data)


def test_odd_rows_and_names(spark):
    r = random.Random(5)
    long_ = " ".join(r.choices([f"w{i}" for i in range(9000)], k=60_000))
    data = [(1, long_, 1), (2, changed(r, long_, 500), 2), (3, "x" * 300_000, 3), (4, "y " * 90_000, 4), (5, "y " * 80_000, 5)]
    data += [(6, "first of one id", 6), (6, "another text of it", 7), (6, "another text of it", 8), (None, None, 9), (None, "", 10)]
    df = spark.createDataFrame(data, "key long, text string, node int").withColumns({"c0": F.lit(1), "__tw_fp": F.lit(2), "a.b": F.lit(3), "bucket": F.lit(4)})
    out = near_dedup.keep_one(df, id_col="key")
    assert out.schema == df.schema
    got = out.collect()
    assert sorted((x.key, x.text[:5]) for x in got if x.key) == [(1, long_[:5]), (3, "xxxxx"), (4, "y y y"), (6, "anoth"), (6, "first")]
    assert len(got) == 6
    assert near_dedup.keep_one(df.where(F.lit(False)), id_col="key").count() == 0


def test_fingerprints_bound_distances():
    r = random.Random(6)
    for n in (40, 400):
        for _ in range(50):
            both = {r.getrandbits(63) for _ in range(round(n * 8 / 9))}
            a, b = (np.array(sorted(both | {r.getrandbits(63) for _ in range(n - len(both))}), np.uint64) for _ in range(2))
            apart = sum((x ^ y).bit_count() for x, y in zip(*(near_dedup.fingerprint(h).view(np.uint64).tolist() for h in (a, b))))
            assert apart <= near_dedup.farthest(0.8) < near_dedup.WIDE / 3


def test_a_large_group_makes_few_pairs(spark, monkeypatch):
    """3,000 near copies of one text, some of them like none, and a chain of texts whose ends are not alike: some pairs a row
    are compared, not all."""
    r = random.Random(8)
    base = " ".join(r.choices([f"w{i}" for i in range(3000)], k=150))
    data = [(i, changed(r, base, 1 if i % 4 else 2)) for i in range(3000)] + [(5000 + i, changed(r, base, 9)) for i in range(60)]
    link = " ".join(r.choices([f"v{i}" for i in range(3000)], k=150))
    for i in range(40):
        data.append((10_000 + i, link))
        link = changed(r, link, 1)
    counted = []
    alike = near_dedup._alike
    monkeypatch.setattr(near_dedup, "_alike", lambda pairs, *a: (counted.append(pairs.count()), alike(pairs, *a))[1])
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    got = sorted(x.doc_id for x in near_dedup.keep_one(df).collect())
    assert got == brute(data[:3] + data[3000:3060] + data[-40:]) == [0, *range(5000, 5060), 10_000]
    assert sum(counted) < 20 * len(data), counted


def test_recall_on_documents(spark):
    """All pairs of the test table's texts: none that is alike is kept twice."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    data = [(x.doc_id, x.text) for x in docs.collect()]
    assert sorted(x.doc_id for x in near_dedup.keep_one(docs).collect()) == brute(data)


def test_operator_4_searches_first(spark):
    """Without any bucket of minima in common: fingerprints within the radius are found by operator 4's search, and linked only if
    the whole sets are alike."""
    r = random.Random(10)
    base = " ".join(r.choices([f"w{i}" for i in range(3000)], k=600))
    texts = [base, base + " end", base + " end", " ".join(r.choices([f"v{i}" for i in range(3000)], k=600)), changed(r, base, 60), "one two"]
    assert all(simhash.majority(near_dedup.all_shingles(t)) == simhash.simhash(t, 5) for t in [*texts, "", None, "a b c d e f"])
    prints = [simhash.simhash(t, 5) for t in texts]
    prints[3] = prints[0]  # by accident
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS < (prints[0] ^ prints[4]).bit_count()
    sets = {i: near_dedup.shingles(t) for i, t in enumerate(texts) if i != 2}
    nodes = [(near_dedup.node(h), str(i), len(h), [1000 * i + k for k in range(near_dedup.BANDS)], prints[i] - (prints[i] >> 63 << 64)) for i, h in sets.items()]
    made = spark.createDataFrame(nodes, f"node long, key string, n long, bands array<long>, {simhash.FP} long")
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    root = {x.node: x.root for x in near_dedup.link_components(docs, made, 5, 0.8).collect()}
    names = [root[n[0]] for n in nodes]
    assert names[0] == names[1] and len(set(names)) == 4 and len(names) == 5


def test_small_graphs_take_few_tasks(spark, monkeypatch):
    made = []
    monkeypatch.setattr(components, "written", lambda df, name, f=components.written: made.append(f(df, name)) or made[-1])
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = components.components(spark.range(600).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, out)) == [(i, 0) for i in range(601)]
    assert len(made) > 3 and all(len(x.inputFiles()) <= 2 for x in made[1:])  # 40 files a round, without a bound


def test_hot_keys_are_dealt_by_their_salt(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("c"), F.col("id").alias("x"))
    table = rows.groupBy("c").agg(F.count("*").alias("weight")).withColumn("v", 2 * F.col("c"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = components.lookup(rows, table, "c", 4000)
        assert "hashpartitioning(c#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and re.search(r"hashpartitioning\(c#\w+, salt#", plan)
        expected = sorted((i if i >= 3000 else -1, i, 2 * i if i >= 3000 else -2) for i in range(4000))
        assert sorted(map(tuple, out.collect())) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, components.lookup(rows, table, "c", 4000, 1001).collect())) == expected


def test_small_buckets_are_compared_without_blocks(spark, monkeypatch):
    r = random.Random(11)
    base = " ".join(r.choice("abcdefgh") + str(r.randrange(300)) for _ in range(120))
    members = []
    for i in range(30):
        h = near_dedup.shingles(changed(r, base, 1) if i < 20 else changed(r, base, 60))
        members.append((7 + i % 2, 40, i, len(h), i // 3, near_dedup.fingerprint(h).tolist(), [100 * i + k for k in range(40)], 0, 15))
    df = spark.createDataFrame(members, "bucket long, band int, node long, n long, c long, fp array<long>, bands array<long>, most long, size long")
    made, pairs = [], {}
    monkeypatch.setattr(near_dedup, "written", lambda df, name, f=near_dedup.written: made.append(f(df, name)) or made[-1])
    for block in (4, 256):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        pairs[block] = {tuple(sorted(x)) for x in near_dedup._close_pairs(df, 0.8).select("a", "b").collect()}
    assert pairs[4] == pairs[256] and len(pairs[256]) > 50
    assert made[0].count() > 4 and made[1].count() == 0  # a block each for most and the others, and a join of all with all
