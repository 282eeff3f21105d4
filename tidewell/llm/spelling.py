"""Spelling variants by wildcard groups, without pairs of words.

Words are near if they differ by exactly one inserted, deleted or replaced character. A word belongs to one group for
each of its positions: (position, prefix, suffix), what is left when the character there is a wildcard. Words of one such
group differ by one replaced character, so the group's size and its top two words (by count, then by code points) answer
for all its members: the top word is every other member's best near word there, the second is the top word's. What is
left without the character is also a deletion, and deletions join the vocabulary: a deletion that is a word is near to
the word that it comes from, and the deletions that give a word are that word's insertions, again by number and top.
Size and top two are read off each group's sorted rows, so a group's answer goes back to its members in the same
shuffle; the answers of a word's groups are added up by word. No pair of words is ever a row.

A word's form is its near word of largest count, if that is at least `ratio` times its own; forms are followed to the
last by pointer doubling, in the logarithm of the longest chain.

Skew: occurrences are counted in each task before the shuffle. A wildcard group has at most as many members as the
alphabet has letters, a word's deletions at most that many for each place, whatever the table holds. Everything is
DataFrame expressions.

Cases: null texts have no words; null ids count as empty in the choice of the character that goes. Ties go to the word
that sorts first by code points. Repeated rows count again. A very long text is one row of many words. An empty table
gives an empty result; other columns are ignored, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import col, written

#: Runs of these are words.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One occurrence in so many, by its document and itself, loses a character.
SLIPS = 97
LEAST_CHARS, LEAST_COUNT, RATIO = 5, 3, 2


def _without(word: Column, at: Column) -> Column:
    """word without the character at a place, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = SLIPS, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts, A-Z lower-cased, that are long and frequent enough. Where `slips` divides the
    CRC-32 of `<id>:<word>`, the character at that number modulo the length goes first; 0 for none."""
    found = F.regexp_extract_all(F.translate(col(text_col).cast("string"), UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    runs = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("word")).where(F.length("word") >= least_chars)
    if slips:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        slip = _without(F.col("word"), (F.col("h") % F.length("word")).cast("int"))
        runs = runs.select("word", h.alias("h")).select(F.when(F.col("h") % slips == 0, slip).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def near(words: DataFrame) -> DataFrame:
    """words: (word, n), one row a word. -> (word, n_near, top, top_n) of those with near words: how many there are, the one
    of largest n, and that n."""
    word, rests = F.col("word"), F.col("rests")
    left = F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: _without(F.col("word"), i)))
    key = lambda at, rest, itself: F.struct(at.cast("int").alias("at"), rest.alias("rest"), F.lit(itself).alias("itself"))
    wildcards = F.transform(rests, lambda rest, i: key(i, rest, False))
    deletions = F.transform(F.array_distinct(rests), lambda rest: key(F.lit(-1), rest, False))
    keyed = words.select("word", "n", left.alias("rests")).select("word", "n", F.explode(F.concat(wildcards, deletions, F.array(key(F.lit(-1), word, True)))).alias("k")).select("word", "n", "k.*")
    # A word itself comes before the deletions that give it.
    group = Window.partitionBy("at", "rest").orderBy(F.desc("itself"), F.desc("n"), "word")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct("word", "n", "itself")
    sized = keyed.select("word", "at", F.row_number().over(group).alias("rank"), F.count("*").over(whole).alias("size"), "itself", F.nth_value(member, 1).over(whole).alias("first"), F.nth_value(member, 2).over(whole).alias("second"))
    wild, is_word = F.col("at") >= 0, F.col("first.itself")
    others = F.when(wild | F.col("itself"), F.col("size") - 1).when(is_word, 1).otherwise(0)
    best = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first"))
    answers = sized.select("word", others.alias("others"), best["word"].alias("best"), best["n"].alias("best_n")).where("others > 0")
    by_word = answers.groupBy("word").agg(F.sum("others").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b"))
    return by_word.select("word", "n_near", F.col("b.best").alias("top"), (-F.col("b.m")).alias("top_n"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: (word, form), one row a word that has a form, without circles. -> (word, root): the last of its forms."""
    at = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        seen = Observation()
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        at = written(jumped.observe(seen, F.count_if("moved").alias("moved")).drop("moved"), "roots")
        if not seen.get["moved"]:
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, slips: int = SLIPS, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n."""
    words = written(vocabulary(docs, id_col, text_col, slips, least_chars, least_count), "vocabulary")
    has = F.coalesce(F.col("top_n") >= ratio * F.col("n"), F.lit(False))
    judged = words.join(near(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("top")).alias("form"), F.when(has, F.col("top_n")).alias("form_n"))
    judged = written(judged, "judged")
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
