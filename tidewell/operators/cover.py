"""Cover-density rank (Clarke, Cormack and Tudhope, 2000) over weighted fields, with a small query language.

A text's fields are one sequence of words, each with the weight of its field's class. A cover is a shortest stretch of it
that satisfies the query: none within it does. A cover counts for the harmonic mean of the weights of the query's words
in it, divided by one more than the number of other words in it; a text's score is the sum over its covers.

Queries: words must all occur; "words in quotes" must follow each other; `or` parts alternatives; what a minus precedes
must not occur (alternatives of such parts only are left out, and they play no role in covers). Case does not matter.

Texts that the query can't hold are left out by plain string search. Of the rest each is read once, word by word, with
the last place of each part of the query and running sums in hand: no positions are paired, and nothing is shuffled but
the best rows. Null fields are empty. No stemming, no stop words."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import top_k

#: Weights of the classes.
CLASSES = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
_GAP = r"[^\p{L}\p{N}]+"

Part = tuple[str, ...]


def parsed(query: str) -> list[tuple[list[Part], list[Part]]]:
    """Alternatives: (parts that must occur, parts that must not), each part words that follow each other."""
    out: list[tuple[list[Part], list[Part]]] = [([], [])]
    for minus, quoted, bare in re.findall(r'(-?)"([^"]*)"|(\S+)', query.lower()):
        if bare == "or":
            out.append(([], []))
            continue
        part = tuple(w for w in re.split(r"[\W_]+", quoted or bare) if w)
        if part:
            out[-1][bool(minus) or bare.startswith("-")].append(part)
    return [(list(dict.fromkeys(yes)), no) for yes, no in out if yes]


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), _GAP), lambda w: w != "")


def _all(conditions: list[Column], join=Column.__and__) -> Column:  # noqa: ANN001
    return functools.reduce(join, conditions) if conditions else F.lit(join is Column.__and__)


def holds(text: Column, query: str) -> Column:
    """Whether a text of words with single spaces between and around satisfies a query."""
    there = lambda part: F.contains(text, F.lit(f" {' '.join(part)} "))
    return _all([_all([there(p) for p in yes] + [~there(p) for p in no]) for yes, no in parsed(query)], Column.__or__)


def cover_density(sequence: Column, query: str) -> Column:
    """The score of an array of (word, inverse weight)."""
    alternatives = [yes for yes, _ in parsed(query)]
    parts = list(dict.fromkeys(p for yes in alternatives for p in yes))
    longest = max((len(p) for p in parts), default=1)
    wanted = F.array(*(F.lit(w) for w in sorted({w for p in parts for w in p}))).cast("array<string>")
    place = F.transform(sequence, lambda t, i: F.struct(i.alias("i"), t["word"].alias("word"), t["inverse"].alias("inverse")))
    entries = F.filter(place, lambda e: F.array_contains(wanted, e["word"]))
    # A start: its place, and how many entries and what sum of inverse weights lie before it.
    start = "struct<i:int,n:int,s:double>"
    none = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("n"), F.lit(0.0).alias("s")).cast(start)
    state = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s"), F.array().cast("array<struct<i:int,word:string,n:int,s:double>>").alias("recent"), F.array(*(none for _ in parts)).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("score"))

    def step(a: Column, e: Column) -> Column:
        recent = F.slice(F.concat(F.array(F.struct(e["i"].alias("i"), e["word"].alias("word"), a["n"].alias("n"), a["s"].alias("s"))), a["recent"]), 1, longest)
        return F.struct(a["n"].alias("n"), a["s"].alias("s"), recent.alias("recent"), a["last"].alias("last"), a["begin"].alias("begin"), a["score"].alias("score"), e["i"].alias("i"), e["inverse"].alias("inverse"))

    def found(b: Column) -> Column:
        def last(j: int, part: Part) -> Column:
            back = [F.get(b["recent"], F.lit(k)) for k in range(len(part))]  # the newest entry first
            ends = _all([back[k]["word"].eqNullSafe(F.lit(w)) & back[k]["i"].eqNullSafe(b["i"] - k) for k, w in enumerate(reversed(part))])
            first = back[-1]
            return F.when(ends, F.struct(first["i"].alias("i"), first["n"].alias("n"), first["s"].alias("s"))).otherwise(b["last"][j]).cast(start)

        return F.struct(b.alias("b"), F.array(*(last(j, p) for j, p in enumerate(parts))).alias("last"))

    def begun(c: Column) -> Column:
        # The latest beginning of a stretch that ends here: of each alternative the earliest of its parts' last places.
        each = [F.array_min(F.array(*(c["last"][parts.index(p)] for p in yes))) for yes in alternatives]
        return F.struct(c["b"].alias("b"), c["last"].alias("last"), F.array_max(F.array(*each)).alias("p"))

    def counted(d: Column) -> Column:
        b, p = d["b"], d["p"]
        n, s = b["n"] + 1, b["s"] + b["inverse"]
        new = p["i"] > b["begin"]
        inside = n - p["n"]
        gained = inside / (s - p["s"]) / (1 + (b["i"] - p["i"]) - (inside - 1))
        return F.struct(n.alias("n"), s.alias("s"), b["recent"].alias("recent"), d["last"].alias("last"), F.greatest(b["begin"], p["i"]).alias("begin"), (b["score"] + F.when(new, gained).otherwise(0.0)).alias("score"))

    then = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  each value is worked out once
    return F.aggregate(entries, state, lambda a, e: then(then(then(step(a, e), found), begun), counted), lambda a: a["score"])


def cover_rank(df: DataFrame, key: str, fields: list[tuple[Column, str]], query: str, k: int) -> DataFrame:
    """(key, score, rank) of the k best rows that satisfy a query; fields: (text, class)."""
    if not parsed(query):
        return df.limit(0).select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    rows = df.select(key, *(words(c).alias(f"w{i}") for i, (c, _) in enumerate(fields)))
    text = F.concat(F.lit(" "), F.array_join(F.concat(*(f"w{i}" for i in range(len(fields)))), " "), F.lit(" "))
    weight = lambda i, c: F.transform(f"w{i}", lambda w: F.struct(w.alias("word"), F.lit(1 / CLASSES[c]).alias("inverse")))
    weighted = [weight(i, c) for i, (_, c) in enumerate(fields)]
    scored = rows.where(holds(text, query)).select(key, F.round(cover_density(F.concat(*weighted), query), 6).alias("score"))
    return top_k(scored, [F.desc("score"), F.asc(key)], k, "rank")
