"""Text functions of the catalogue as column expressions; pandas UDFs only where Spark has no built-in."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say nothing about an event.
FILLER = [
    "the", "and", "with", "for", "from", "out", "you", "your", "its", "are", "was", "this", "that", "into", "all", "new", "one", "two",
    "live", "event", "events", "show", "shows", "night", "nights", "music", "party", "concert", "set", "series", "performs", "presents",
    "featuring", "join", "come", "experience", "enjoy", "celebrate", "discover", "more", "than", "their", "his", "her",
]
# Placeholders that stand for no value.
NO_TEXT = r"(?i)^(tba|tbc|n/a|none|null|-|—)$"
NO_FIELD = r"(?i)^(unknown|tba|tbc|n/a|none|null|other|-)$"
NO_VENUE = r"^(various|various venues|multiple|tbd|tba|tonight|see telegram|unknown)\.*$"
# Moods that a pick may carry.
MOODS = ["quiet", "loud", "indoors", "outdoors", "solo", "social", "drinks", "sober", "walk-up", "ticketed"]
# Kinds of food places, shown only with a day; kinds of venues shown on their own.
FOOD_KINDS = ["bar", "cafe", "restaurant", "food", "eatery", "place"]
VENUE_KINDS = ["record store", "bookshop", "gallery", "club", "thrift", "arts centre", "cinema", "community"]
# Kind -> mark on the map; any other is a plain place.
MARKS = {
    "gig": "gig", "concert": "gig", "music": "gig", "talk": "gig", "lecture": "gig",
    "club": "club", "party": "club", "rave": "club",
    "record store": "records", "records": "records", "vinyl": "records",
    "gallery": "gallery", "exhibition": "gallery", "art": "gallery", "museum": "gallery", "arts centre": "gallery",
    "film": "film", "cinema": "film", "screening": "film", "theatre": "film", "burlesque": "film",
    "market": "market", "flea": "market", "thrift": "market", "fair": "market",
    "bar": "bar", "cafe": "bar", "pub": "bar", "club_bar": "bar",
    "bookshop": "books", "books": "books", "library": "books", "community": "books",
}
# What a prompt asks for, by pattern.
PROMPT_KINDS = [
    (r"vinyl|record|lp\b|dj|crate", "record store"),
    (r"book|read|zine|literatur", "bookshop"),
    (r"galler|art\b|exhibit|paint|photo", "gallery"),
    (r"club|techno|rave|dance|gig|concert|live music|venue", "club"),
    (r"thrift|vintage|second.?hand|flea|kirbu", "thrift"),
    (r"arts centre|art center|culture|cultural|studio", "arts centre"),
    (r"cinema|film|movie|screening", "cinema"),
    (r"community|diy|collective|workshop|maker", "community"),
    (r"theatre|theater|stage|perform|comedy|improv", "theatre"),
]
# Map tags -> kind of venue; the first that fits.
TAG_KINDS = [
    ("amenity", "nightclub", "club"), ("amenity", "bar", "bar"), ("amenity", "pub", "bar"), ("amenity", "theatre", "theatre"),
    ("amenity", "cinema", "cinema"), ("amenity", "arts_centre", "arts centre"), ("amenity", "library", "library"),
    ("amenity", "community_centre", "community"), ("shop", "books", "bookshop"), ("shop", "music", "record store"),
    ("shop", "second_hand", "thrift"), ("tourism", "gallery", "gallery"), ("tourism", "museum", "museum"),
]


def _or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def or_null(c: Column) -> Column:
    """Trimmed; empty becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def slug(c: Column, n: int = 30) -> Column:
    """Lower case, other signs as single hyphens, none at the ends, cut to n (the cut may leave one)."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(_or_empty(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, n)


def initials(c: Column) -> Column:
    """First letters of the first two words, or the first two of a single word; '??' for none."""
    w = F.filter(F.split(F.trim(_or_empty(c)), r"\s+"), lambda x: x != "")
    two = F.concat(F.substring(w[0], 1, 1), F.substring(F.try_element_at(w, F.lit(2)), 1, 1))
    return F.when(F.size(w) == 0, F.lit("??")).when(F.size(w) == 1, F.upper(F.substring(F.try_element_at(w, F.lit(1)), 1, 2))).otherwise(F.upper(two))


def content_words(c: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(_or_empty(c)), "[^a-z0-9 ]", " "), r"\s+")
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 3), F.array(*(F.lit(w) for w in FILLER)))


def says_something(text: Column, title: Column) -> Column:
    """The text if its first 300 characters hold a content word that the title lacks; else empty."""
    s = F.trim(_or_empty(text))
    new = F.size(F.array_except(content_words(F.substring(s, 1, 300)), content_words(title))) > 0
    return F.when((F.length(s) >= 12) & ~s.rlike(NO_TEXT) & new, s).otherwise(F.lit(""))


def real_or_empty(c: Column) -> Column:
    """Placeholders become empty."""
    s = F.trim(_or_empty(c))
    return F.when(s.rlike(NO_FIELD), F.lit("")).otherwise(s)


def is_generic_venue(c: Column) -> Column:
    s = F.trim(_or_empty(c))
    return (s == "") | F.lower(s).rlike(NO_VENUE)


def strip_tags(c: Column) -> Column:
    """Tags become spaces, common entities their signs, white space single spaces."""
    s = F.regexp_replace(_or_empty(c), "<[^>]*>", " ")
    # Named entities; the ampersand's comes last, so that none is decoded twice.
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


@F.pandas_udf(T.StringType())
def unescape_html(c: pd.Series) -> pd.Series:
    """All entities, numeric ones too: Spark has no function for them."""
    return c.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def fold_accents(c: pd.Series) -> pd.Series:
    """Lower case without combining accents."""
    return c.map(lambda s: "".join(x for x in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(x)), na_action="ignore")


def normalised_name(c: Column) -> Column:
    """For comparing names: no case, accents or punctuation."""
    return F.trim(F.regexp_replace(fold_accents(c), "[^a-z0-9]+", " "))


def slug_folded(c: Column, n: int = 80) -> Column:
    return slug(fold_accents(c), n)


def escape_html(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def escape_ics(c: Column) -> Column:
    for sign, name in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def join_parts(sep: str, *parts: Column) -> Column:
    """Parts that are not empty, joined."""
    return F.concat_ws(sep, *(F.nullif(p.cast("string"), F.lit("")) for p in parts))


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def is_cyrillic(c: Column) -> Column:
    return c.rlike("[\\u0400-\\u04FF]")


def mark(kind: Column) -> Column:
    table = F.create_map(*(F.lit(v) for kv in MARKS.items() for v in kv))
    return F.coalesce(F.try_element_at(table, F.trim(F.lower(_or_empty(kind)))), F.lit("place"))


def kind_of_tags(tags: Column) -> Column:
    """Kind of venue from a map of tags."""
    hit = [F.when(F.try_element_at(tags, F.lit(k)) == v, F.lit(kind)) for k, v, kind in TAG_KINDS]
    return F.coalesce(*hit)


def kinds_of_prompt(prompt: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*(F.when(_or_empty(prompt).rlike(f"(?i){p}"), F.lit(k)) for p, k in PROMPT_KINDS))))


def valid_moods(tags: Column) -> Column:
    return F.filter(tags, lambda t: t.isin(MOODS))


def first_keyword(text: Column, keywords: list[str]) -> Column:
    """The first of the keywords that the text holds, without regard to case."""
    t = F.lower(_or_empty(text))
    return F.coalesce(*(F.when(t.contains(k.lower()), F.lit(k)) for k in keywords))


def number_word(n: Column) -> Column:
    # Numbers in words.
    words = F.array(*(F.lit(w) for w in ("None", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten")))
    return F.coalesce(F.get(words, n.cast("int")), n.cast("string"))


def ago(then: Column, now: Column) -> Column:
    """Whole days ago in words: today, yesterday, n days ago."""
    d = F.datediff(now, then)
    return F.when(d <= 0, F.lit("today")).when(d == 1, F.lit("yesterday")).otherwise(F.concat(d.cast("string"), F.lit(" days ago")))


def ago_spoken(then: Column, now: Column) -> Column:
    """Of whole periods of 24 hours: today, yesterday, n days, weeks from 14 days on, months from 60; empty for later times
    and unknown ones."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    d = F.floor(seconds / 86_400_000_000)
    many = lambda days, word: F.concat(F.floor(d / days + 0.5).cast("string"), F.lit(f" {word} ago"))
    said = F.when(d < 1, "today").when(d == 1, "yesterday").when(d < 14, F.concat(d.cast("string"), F.lit(" days ago"))).when(d < 60, many(7, "weeks")).otherwise(many(30, "months"))
    return F.coalesce(F.when(seconds >= 0, said), F.lit(""))


def ago_rounded(then: Column, now: Column, short: bool = False) -> Column:
    """Minutes, hours or days, each rounded from the one before: '1 minute ago', '3 hours ago'; short: '3 hr ago'."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    minutes = F.floor(micros / 60_000_000 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    word = lambda n, brief, long: F.concat(n.cast("string"), F.lit(f" {brief} ago") if short else F.concat(F.lit(f" {long}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago")))
    said = F.when(minutes < 60, word(minutes, "min", "minute")).when(hours < 24, word(hours, "hr", "hour")).otherwise(word(days, "d", "day"))
    return F.coalesce(F.when(micros >= 0, said), F.lit(""))


def embedding_text(title: Column, venue: Column, neighborhood: Column, kind: Column, quote: Column, moods: Column) -> Column:
    """What a pick's vector is made of: its fields and mood tags, missing ones left out."""
    return join_parts(" · ", title, venue, neighborhood, kind, quote, F.array_join(moods, " "))


def tolerant_json(c: Column) -> Column:
    """A VARIANT from text that is JSON, holds a fenced block of it, or holds it between its outermost braces."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(F.trim(c)), F.try_parse_json(fenced), F.try_parse_json(braces))


def retry_seconds(message: Column) -> Column:
    """Seconds that a message asks to wait (14 if it says none) plus two."""
    n = F.regexp_extract(_or_empty(message), r"(\d+(?:\.\d+)?)\s*s", 1).try_cast("double")
    return F.coalesce(F.ceil(n), F.lit(14)) + 2


def address(parts: Column, shown: Column) -> Column:
    """'road number, postcode city' from a struct of (road, number, postcode, city), else the display name's first three parts."""
    street = join_parts(" ", parts["road"], parts["number"])
    town = join_parts(" ", parts["postcode"], parts["city"])
    made = join_parts(", ", street, town)
    return F.when(parts["road"].isNotNull(), made).otherwise(F.array_join(F.slice(F.split(shown, r",\s*"), 1, 3), ", "))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each padded with two spaces before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(_or_empty(c)), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Share of distinct trigrams in common; 0 for two texts without any."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def _utf16(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place by place, the texts that have a UTF-16 unit there and those units. Longest texts come first, so that a place is
    a prefix of them."""
    units = [np.frombuffer(s.encode("utf-16-le", "surrogatepass"), "<u2") for s in texts]
    order = sorted(range(len(units)), key=lambda i: -len(units[i]))
    ends = np.cumsum([len(units[i]) for i in order])
    flat, sizes = np.concatenate([units[i] for i in order] or [np.zeros(0, "<u2")]).astype(np.uint64), np.array([len(units[i]) for i in order])
    starts, which = ends - sizes, np.array(order)
    for k in range(sizes[0] if len(sizes) else 0):
        n = np.searchsorted(-sizes, -k, "left")
        yield which[:n], flat[starts[:n] + k]


def _each(c: pd.Series, one: Callable[[list[str]], np.ndarray]) -> pd.Series:
    out, there = pd.Series([None] * len(c), index=c.index, dtype="Int64"), c.notna()
    out[there] = one(c[there].tolist()).astype(np.int64)
    return out


_LOW = np.uint64(0xFFFFFFFF)


@F.pandas_udf(T.LongType())
def cyrb53(c: pd.Series) -> pd.Series:
    """The 53-bit string hash of that name (seed 0), over UTF-16 units, with 32-bit wrapping products; a batch's texts go
    forward together, a place at a time."""

    def one(texts: list[str]) -> np.ndarray:
        # The hash's seeds and multipliers.
        h1, h2 = np.full(len(texts), 0xDEADBEEF, np.uint64), np.full(len(texts), 0x41C6CE57, np.uint64)
        for at, unit in _utf16(texts):
            h1[at] = (h1[at] ^ unit) * np.uint64(2654435761) & _LOW
            h2[at] = (h2[at] ^ unit) * np.uint64(1597334677) & _LOW
        mixed = lambda a, b: (a ^ a >> np.uint64(16)) * np.uint64(2246822507) & _LOW ^ (b ^ b >> np.uint64(13)) * np.uint64(3266489909) & _LOW
        h1 = mixed(h1, h2)
        h2 = mixed(h2, h1)
        return (h2 & np.uint64(0x1FFFFF)) << np.uint64(32) | h1

    return _each(c, one)


@F.pandas_udf(T.LongType())
def fnv53(c: pd.Series) -> pd.Series:
    """FNV-1a with 64 bits over UTF-16 units, its low 53 bits; a batch's texts together, as above."""

    def one(texts: list[str]) -> np.ndarray:
        # FNV's offset basis and prime.
        h = np.full(len(texts), 0xCBF29CE484222325, np.uint64)
        for at, unit in _utf16(texts):
            h[at] = (h[at] ^ unit) * np.uint64(0x100000001B3)
        return h & np.uint64(0x1FFFFFFFFFFFFF)

    return _each(c, one)


def like_literal(term: str) -> str:
    """A term with LIKE's wildcards escaped."""
    return re.sub(r"([%_\\])", r"\\\1", term)


def _signed(code: Column) -> Column:
    """The sign of a code as a UTF-16 unit: larger numbers wrap around."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long").bitwiseAND(F.lit(0xFFFF))), 4, "0")), "UTF-16BE")


def numeric_entities(c: Column) -> Column:
    """Entities of numbers, &#233; and &#xE9;, as their signs; the decimal ones first. Each that there is is replaced once,
    wherever it stands; those of more digits than a number can have stay."""
    for pattern, base in ((r"&#([0-9]{1,9});", 10), (r"(?i)&#x([0-9a-f]{1,8});", 16)):
        found = F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
        digits = lambda m, p=pattern: F.regexp_extract(m, p, 1)
        c = F.aggregate(found, c, lambda s, m: F.replace(s, m, _signed(F.conv(digits(m), base, 10))))  # noqa: B023
    return c


# Each listing's way with tags: what a tag becomes, entities in their order, numbers too, white space to
# single spaces, the most characters.
STRIPPERS = {
    "cinema": (" ", ("&amp;", "&lt;", "&gt;", "&quot;", "&nbsp;"), True, True, None),
    "channel": ("", ("&nbsp;", "&amp;", "&lt;", "&gt;", "&quot;", "&#39;"), False, False, None),
    "tickets": (" ", ("&nbsp;", "&amp;", "&lt;", "&gt;", "&quot;", "&#39;"), False, True, 600),
    "feed": (" ", ("&nbsp;", "&amp;", "&lt;", "&gt;", "&quot;", "&#39;"), False, True, None),
    "facts": (" ", ("&nbsp;",), False, True, 4000),
}
_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&#39;": "'"}


def stripped(c: Column, way: str) -> Column:
    """Tags and entities as one of STRIPPERS takes them; entities are replaced one after the other, so that what one makes
    the next may take. A channel's line breaks stay lines. Facts are null if nothing is left."""
    tag, entities, numbers, collapse, most = STRIPPERS[way]
    s = _or_empty(c)
    if way == "channel":
        s = F.regexp_replace(s, r"(?i)<br\s*/?>", "\n")
    s = F.regexp_replace(s, "<[^>]*>" if way == "facts" else "<[^>]+>", tag)
    for e in entities:
        s = F.replace(s, F.lit(e), F.lit(_ENTITIES[e]))
    s = numeric_entities(s) if numbers else s
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"\s+", " ") if collapse else s
    s = F.substring(s, 1, most) if most else s
    return F.nullif(s, F.lit("")) if way == "facts" else s
