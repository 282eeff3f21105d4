"""License scanning by an exact set-similarity join, in DataFrame expressions only.

Words are the runs of digits, letters a-z (after lower-casing A-Z) and characters beyond ASCII. Three findings:

Base phrases: all places where a phrase's words stand consecutively, found by string functions on the text's words,
each written between spaces of its own.

Names: a license's short name as a pattern over a text's words, with its kind and version in full (`cc by sa 4 0`). A
name of few words is all of it or nothing, as the one word that tells licenses apart may be the one that is missing.

Templates: paragraphs of licenses. A block is any run of so many consecutive words as the template has and a quarter
more, however they are wrapped into lines. A block matches if it holds at least `threshold` of the template's distinct
words, and all phrases in which the template names its license and version, if it has any. The join: template words are
ordered by how many documents of the whole table hold them, rarest first. What reaches the threshold must share a word
with the template's prefix, its first |T| - ceil(threshold * |T|) + 1 words (prefix filter); it must have at least
ceil(threshold * |T|) words of templates (length filter); and if the first shared word stands at position p of the order,
at most |T| - p words can be shared (positional filter). Whole texts go through these filters first, and only templates
that pass there are looked for in the text's blocks: those that begin at a word of the template, as any other that
matches holds no more of it than the one that begins at its first. The index from prefix words to templates is a literal
map, as templates are a parameter, so the join needs no shuffle: only the counts for the word order are aggregated, one
row a template word.

Cases: null counts as empty; texts without words have no labels and score 0. Repeated rows each get an answer. An empty
table gives an empty result; extra columns are dropped. A word that no document holds is rarest of all; words held
equally often are ordered by text. Without templates and names only phrases are found. Phrases that overlap themselves
are refused. A very long text costs in proportion to the words that it shares with the templates that it may hold."""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Label -> paragraphs of public licenses, each with the phrases that it must hold besides.
TEMPLATES = {
    "mit": [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", []),
        ("to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", []),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", []),
    ],
    "apache-2": [
        ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses license 2 0"]),
        ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", []),
    ],
    "gpl-3-or-later": [("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu general public license", "version 3", "any later version"])],
    "gpl-2-or-later": [("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["gnu general public license", "version 2", "any later version"])],
    "lgpl-2.1-or-later": [("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["gnu lesser general public license", "version 2 1", "any later version"])],
    "lgpl-3-or-later": [("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu lesser general public license", "version 3", "any later version"])],
    "agpl-3-or-later": [("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu affero general public license", "version 3", "any later version"])],
    "bsd": [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", []),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", []),
        ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", []),
    ],
    "isc": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["permission to use copy modify", "without fee"])],
    "mpl-2": [
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
        ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["mozilla org mpl 2 0"]),
    ],
}
_UNDER = "(?:under|licen[cs]e|identifier) (?:the |a |an )?(?:terms of )?(?:the )?"
_CC = "(?:cc|creative commons)"
_VERSION = "(?:version |v )?v?"
# Label -> patterns of licenses' names over words with one space between. A kind that goes on (by nc, by sa)
# is another license, so a number or the word license follows; a version that goes on is another, too.
NAMES = {
    "mit": [f"{_UNDER}(?:mit|expat) licen[cs]e", "identifier (?:mit|expat)"],
    "apache-2": [f"{_UNDER}apache (?:software |public )?(?:licen[cs]e )?{_VERSION}2(?: 0)?"],
    "mpl-2": [f"mozilla (?:public )?licen[cs]e {_VERSION}2(?: 0)?", "mpl 2 0"],
    "isc": [f"{_UNDER}isc licen[cs]e"],
    "bsd": [f"{_UNDER}(?:original )?bsd licen[cs]e"],
    "bsd-2": ["(?:2|two) clause bsd licen[cs]e", "bsd 2 clause", f"{_UNDER}simplified bsd licen[cs]e"],
    "bsd-3": ["(?:3|three) clause bsd licen[cs]e", "bsd 3 clause", f"{_UNDER}(?:new|revised|modified) bsd licen[cs]e"],
    "gpl-2": [f"gnu general public licen[cs]e {_VERSION}2", "gpl v?2", "gplv2"],
    "gpl-3": [f"gnu general public licen[cs]e {_VERSION}3", "gpl v?3", "gplv3"],
    "lgpl-2.1": [f"gnu lesser general public licen[cs]e {_VERSION}2 1", "lgpl v?2 1", "lgplv2 1"],
    "lgpl-3": [f"gnu lesser general public licen[cs]e {_VERSION}3", "lgpl v?3", "lgplv3"],
    "agpl-3": [f"(?:gnu )?affero general public licen[cs]e {_VERSION}3", "agpl v?3", "agplv3"],
    "cc0": ["cc0(?: 1 0)?"],
    "cc-by": [f"{_CC} (?:by|attribution) (?:[1-4] [0-9]|[1-4]|(?:international |public )?licen[cs]e)"],
    "cc-by-sa": [f"{_CC} (?:by|attribution) (?:sa|share ?alike) (?:[1-4] [0-9]|[1-4]|(?:international |public )?licen[cs]e)"],
    "cc-by-nd": [f"{_CC} (?:by|attribution) (?:nd|no ?deriv(?:ative)?s) (?:[1-4] [0-9]|[1-4]|(?:international |public )?licen[cs]e)"],
    "cc-by-nc": [f"{_CC} (?:by|attribution) (?:nc|non ?commercial) (?:[1-4] [0-9]|[1-4]|(?:international |public )?licen[cs]e)"],
    "cc-by-nc-sa": [f"{_CC} (?:by|attribution) (?:nc|non ?commercial) (?:sa|share ?alike) (?:[1-4] [0-9]|[1-4]|(?:international |public )?licen[cs]e)"],
    "cc-by-nc-nd": [f"{_CC} (?:by|attribution) (?:nc|non ?commercial) (?:nd|no ?deriv(?:ative)?s) (?:[1-4] [0-9]|[1-4]|(?:international |public )?licen[cs]e)"],
}
#: No name without one of these.
NAMED_BY = ["licen", "apache", "cc ", "cc0", "commons", "gpl", "mpl", "bsd", "identifier"]
THRESHOLD = 0.8
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(text: Column) -> Column:
    # lower() differs from lower-casing A-Z only beyond ASCII, where phrases and templates have nothing. The two signs
    # that it would turn into ASCII letters (Kelvin, dotted I) are put out of its way.
    return F.lower(F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ķ")), F.lit("İ"), F.lit("ī")))


def _count(words: Column, part: str) -> Column:
    return ((F.octet_length(words) - F.octet_length(F.replace(words, F.lit(part), F.lit("")))) / len(part.encode())).cast("long")


def _n_words(words: Column) -> Column:
    """words: each between spaces of its own, " a  b  c "."""
    return F.when(words == "", F.lit(0).cast("long")).otherwise(_count(words, "  ") + 1)


def words_of(text: str) -> list[str]:
    """The words of a phrase or template."""
    return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _known_words(text: Column, known: Column) -> Column:
    """Of a text of words between spaces, those that are known."""
    return F.array_intersect(known, F.split(text, " "))


def span_of(text: str) -> int:
    """Words of a block."""
    n = len(words_of(text))
    return n + n // 4


def _bound(value: Column, f) -> Column:  # noqa: ANN001
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _best_share(words: Column, t: Column) -> Column:
    """The largest share of a template's words in a block that matches, or null."""
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda h: F.array_contains(t["words"], h["w"]))

    def shares(hits: Column) -> Column:
        def block(h: Column, k: Column) -> Column:
            within = F.filter(F.slice(hits, k + 1, t["span"]), lambda x: x["i"] < h["i"] + t["span"])
            return F.struct(h["i"].alias("i"), F.size(F.array_distinct(F.transform(within, lambda x: x["w"]))).alias("n"))

        def named(b: Column) -> Column:
            text = F.concat(F.lit(" "), F.array_join(F.slice(words, b["i"] + 1, t["span"]), " "), F.lit(" "))
            return F.forall(t["phrases"], lambda p: F.contains(text, p))

        enough = F.filter(F.transform(hits, block), lambda b: b["n"] >= t["need"])
        return F.array_max(F.transform(F.filter(enough, named), lambda b: b["n"])) / F.size(t["words"])

    return _bound(hits, shares)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, list[tuple[str, list[str]]]] | None = None, names: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every document: id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a base phrase or a
    name; else the largest share of a matching template that a block holds; else 0)."""
    phrases = {" ".join(words_of(p)): label for p, label in (PHRASES if phrases is None else phrases).items()}
    names = NAMES if names is None else names
    if any(p.split()[:k] == p.split()[-k:] for p in phrases for k in range(1, len(p.split()))):
        raise ValueError("a phrase that overlaps itself")
    flat = [(label, sorted(set(words_of(t))), span_of(t), needs) for label, texts in (TEMPLATES if templates is None else templates).items() for t, needs in texts]
    known = sorted({w for _, ws, _, _ in flat for w in ws})
    strings = lambda ws: F.array(*(F.lit(w) for w in ws)).cast("array<string>")
    literal = strings(known)
    lines = docs.select(F.col(id_col).alias("id"), F.trim(F.regexp_replace(_lower(F.col(text_col)), GAP, " ")).alias("inner"))
    held = lines.select(F.explode(_known_words(F.col("inner"), literal)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    held_by = {r["word"]: r["n"] for r in held.collect()} if known else {}  # at most one row a template word
    index: dict[str, list[Column]] = {}
    for label, ws, span, needs in flat:
        ranked = sorted(ws, key=lambda w: (held_by.get(w, 0), w))
        need = math.ceil(threshold * len(ws) - 1e-9)
        for p, w in enumerate(ranked[: len(ws) - need + 1]):
            entry = F.struct(F.lit(label).alias("label"), strings(ranked).alias("words"), strings(ranked[:p]).alias("before"), F.lit(p).alias("p"), F.lit(need).alias("need"), F.lit(span).alias("span"), strings([f" {x} " for x in needs]).alias("phrases"))
            index.setdefault(w, []).append(entry)
    by_word = F.create_map(*(x for w, entries in index.items() for x in (F.lit(w), F.array(*entries))))
    prefix = strings(sorted(index))
    none_found = F.array().cast("array<struct<label:string,share:double>>")

    def candidates(held: Column) -> Column:
        """The templates of which a set of words holds enough."""
        def fits(t: Column) -> Column:
            # Only the first shared word puts a pair out, so no pair comes twice.
            return (F.size(t["words"]) - t["p"] >= t["need"]) & ~F.arrays_overlap(held, t["before"]) & (F.size(F.array_intersect(t["words"], held)) >= t["need"])

        return F.flatten(F.transform(F.array_intersect(prefix, held), lambda w: F.filter(by_word[w], fits)))

    def found_in(words: Column) -> Column:
        shown = F.transform(F.col("possible"), lambda t: F.struct(t["label"].alias("label"), _best_share(words, t).alias("share")))
        return F.filter(shown, lambda f: f["share"].isNotNull())

    rows = lines
    if flat:
        rows = rows.withColumn("possible", _bound(_known_words(F.col("inner"), literal), candidates))
        found = F.when(F.size("possible") > 0, _bound(F.split("inner", " "), found_in)).otherwise(none_found)
    else:
        found = none_found
    padded = F.concat(F.lit(" "), F.col("inner"), F.lit(" "))
    may_name = functools.reduce(Column.__or__, (F.contains("inner", F.lit(x)) for x in NAMED_BY))
    named = F.array(*(F.when(padded.rlike(f" (?:{'|'.join(patterns)}) "), F.lit(label)) for label, patterns in names.items())).cast("array<string>")
    named = F.when(may_name, F.array_compact(named)).otherwise(F.array().cast("array<string>"))
    spaced = F.when(F.col("inner") == "", "").otherwise(F.concat(F.lit(" "), F.replace(F.col("inner"), F.lit(" "), F.lit("  ")), F.lit(" ")))
    rows = rows.select("id", spaced.alias("w"), found.alias("found"), named.alias("named"))
    w = F.col("w")
    marks = {p: "".join(f" {x} " for x in p.split()) for p in phrases}
    rows = rows.select("id", "w", "found", "named", _n_words(w).alias("n_words"), *(_count(w, m).alias(f"n{i}") for i, m in enumerate(marks.values())))

    def first(m: str) -> Column:
        at = F.locate(m, w)
        return _n_words(F.substring(w, F.lit(1), at - 1))

    def last(p: str, m: str) -> Column:
        return F.col("n_words") - len(p.split()) - _n_words(F.substring_index(w, m, -1))

    firsts = [F.when(F.col(f"n{i}") > 0, first(m)) for i, m in enumerate(marks.values())]
    lasts = [F.when(F.col(f"n{i}") > 0, last(p, m)) for i, (p, m) in enumerate(marks.items())]
    none = F.lit(None).cast("long")
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.col(f"n{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())))).cast("array<string>")))
    n_base = sum((F.col(f"n{i}") for i in range(len(marks))), F.lit(0).cast("long"))
    labels = F.array_sort(F.array_union(F.array_union(base, "named"), F.transform("found", lambda f: f["label"])))
    score = F.when((n_base > 0) | (F.size("named") > 0), 1.0).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)))
    return rows.select(F.col("id").alias(id_col), "n_words", n_base.alias("n_base"), F.least(*firsts, none, none).alias("first_word"), F.greatest(*lasts, none, none).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
