"""The trie of prefixes against plain dictionaries."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from tidewell.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}


def rebuilt(own):
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        ts = tuple(convs[c])
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
        ends[ts].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, cs in members.items():
        own = (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += not children[p]
    return sorted(((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, cs in members.items()), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    got = [tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(df)).select(COLUMNS).collect()]
    assert sorted(got, key=str) == brute(rebuilt(ordered(rows)))
    plain = [tuple(r) for r in prefix_trie.trie(df).select(COLUMNS).collect()]
    assert sorted(plain, key=str) == brute(ordered(rows))
    return got


def test_trie_matches_plain(spark):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["", "é🙂", "b", None, "long " * 50])) for c in range(80) for t in range(rnd.randint(1, 6))]
    rows += [(100, 0, "user", "a"), (101, None, "user", "a"), (101, 3, None, None), (101, 3, "user", "x"), (101, 3, "user", "x"), (None, 0, "user", "lost"), (-3, 0, "user", "a"), (2**40, 5, "user", "z" * 100_000)]
    got = check(spark, rows + rows[:40])
    assert sum(r[1] == 0 for r in got) == 1
    assert check(spark, []) == []


def test_one_hot_conversation_and_one_hot_first_turn(spark, monkeypatch):
    """A long conversation takes few rounds: runs of single children are contracted."""
    made = []
    write = prefix_trie.written
    monkeypatch.setattr(prefix_trie, "written", lambda df, name: (made.append(name), write(df, name))[1])
    rows = [(0, t, "user", f"t{t % 7}") for t in range(700)] + [(5, t, "user", f"t{t % 7}") for t in range(350)] + [(7, t, "user", f"t{t % 7}") for t in range(500)]
    rows += [(c, 0, "user", "t0") for c in range(10, 300)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    got = [tuple(r) for r in prefix_trie.trie(df).select(COLUMNS).collect()]
    assert sorted(got, key=str) == brute(ordered(rows))
    assert made.count("complete") <= 6 and made.count("chains") <= 13


@pytest.mark.parametrize("size", [1, 3])
def test_members_without_turns(spark, size):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    members = spark.createDataFrame([(c,) for c in range(size)], "conv_id long")
    (r,) = prefix_trie.trie(none, members).collect()
    assert (r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) == (0, 0, None, size, 0, 1, 0)
    assert r.ends_sha256 == hashlib.sha256(",".join(map(str, range(size))).encode()).hexdigest()
