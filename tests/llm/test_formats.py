import hashlib
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat_format, license_scan, url_filter

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(df)
    return {r.conv_id: r for r in out.withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("learned", chat_format.learned_text(F.col("formatted"), F.col("loss_spans"))).collect()}


def test_chats_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<~/s>[~~SEP]", "ends <", "[", "", None, "[SEP][/ROLE]<s>", "$1 \\ ~", "é🙂\n[ROLE]x", "<~~/s"]
    rows = [(1, i, ("user", "assistant", "assistant", None, "[ROLE]</s>")[i % 5], t) for i, t in enumerate(nasty * 2)]
    rows += [(2, 0, "user", None), (None, 1, "assistant", "a"), (None, None, "assistant", "b"), (3, 5, "assistant", "y"), (3, 5, "assistant", "x"), (3, 5, "assistant", "x")]
    got = formatted(spark, rows)
    assert len(got) == 4
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2] or "", r[3] or "") for r in rows[:20]]
    assert got[1].learned == "".join(t or "" for _, _, r, t in rows[:20] if r == "assistant")
    assert [t.text for t in got[None].turns] == ["b", "a"]
    assert [t.text for t in got[3].turns] == ["x", "x", "y"] and got[3].formatted.count("<s>") == 1
    assert got[2].loss_spans == [] and got[2].formatted == "<s>[ROLE]user[/ROLE]</s>"
    assert formatted(spark, []) == {}


def test_urls_and_rules(spark):
    urls = ["http://a.example.com/en/7?x", "HTTP://A.EXAMPLE.COM/EN/7", "https://example.com/en/6#f", "x://net/de/81", "//example.net/de", "http://b.example.net/de/8", None, "", "http://notcom/en/", "http://com/en/1", "ftp://h?q", "http://org:80/es/", "http://x.org/es/?://y"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = url_filter.judge(pages, none).orderBy("page_id").collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[r.page_id]
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0]
            path = re.split("[?#]", rest[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = max(((len(h + p), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, fit[1], fit[2])
    assert url_filter.judge(pages.limit(0), none).count() == 0


def test_rules_of_the_contract(spark):
    want = {
        "http://com/en/1": ("com/en/", "block"), "http://a.example.com/en/6": ("com/en/", "block"), "http://a.example.com/en/71": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"), "http://x.net/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://EXAMPLE.net/de/8": ("example.net/de/8", "block"), "http://a.example.net/de/81?x": ("example.net/de/8", "block"), "http://q.org/es/2": ("org/es/", "block"),
        "http://example.org/en/7": (None, "allow"), "http://net/en/": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame([], "url string, bad boolean")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == list(want.values())


def test_reputation_shrinks_from_host_to_suffix(spark):
    rows = [("http://bad.spam.example/x", True)] * 40 + [("http://other.spam.example/x", True)] * 30 + [("http://good.site.example/x", False)] * 400 + [("http://few.site.example/", True)] + [("http://x.fine.test/", False)] * 300 + [("http://null.test/", None)]
    outcomes = spark.createDataFrame(rows, "url string, bad boolean")
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["bad.spam.example", "new.spam.example", "good.site.example", "few.site.example", "new.site.example", "nowhere.zzz"])], "page_id long, url string")
    got = {r.host: r for r in url_filter.judge(pages, outcomes, rules=[]).collect()}
    assert got["bad.spam.example"].verdict == got["new.spam.example"].verdict == "block"
    assert {got[h].verdict for h in ("good.site.example", "few.site.example", "new.site.example", "nowhere.zzz")} == {"allow"}
    assert got["few.site.example"].bad_bound > got["good.site.example"].bad_bound


def test_suffixes_ports_and_addresses(spark):
    names = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "b.co.uk:8080": ("b.co.uk", "co.uk"), "x.y.com:81": ("y.com", "com"), "com": ("com", "com"), "10.0.0.4": ("10.0.0.4", "numeric"), "10.0.0.4:80": ("10.0.0.4", "numeric"), "[::1]:80": ("[::1]", "numeric"), "": ("", ""), "a.b.city.zz": ("city.zz", "zz"), "x.city.zz": ("city.zz", "zz")}
    hosts = spark.createDataFrame([(h,) for h in names], "host string")
    got = {r.host: (r.domain, r.suffix) for r in url_filter.named(hosts).collect()}
    assert got == names
    rules = spark.createDataFrame([("co.uk",), ("city.zz",), ("zz",)], "rule string")
    listed = {r.host: (r.domain, r.suffix) for r in url_filter.named(hosts, rules).collect()}
    assert listed == names | {"a.b.city.zz": ("b.city.zz", "city.zz"), "x.city.zz": ("x.city.zz", "city.zz")}


def test_a_bad_domain_does_not_taint_its_suffix(spark):
    bad = [(f"http://shop.bad{k}.co.uk/{i}", True) for k in ("", "2") for i in range(100)]
    fine = [(f"http://fine{k}.co.uk/{i}", False) for k in range(40) for i in range(3)]
    outcomes = spark.createDataFrame(bad + fine, "url string, bad boolean")
    pages = spark.createDataFrame([(i, f"http://{h}/" + "x" * (100_000 if i == 3 else 0)) for i, h in enumerate(["shop.bad.co.uk", "new.bad2.co.uk", "good.co.uk", "new.co.uk"])], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, outcomes, rules=[]).collect()} == {0: "block", 1: "block", 2: "allow", 3: "allow"}


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    labels = {label for _, label in places}
    more, best = set(labels), 0.0
    for label, patterns in license_scan.NAMES.items():
        if re.search(f" (?:{'|'.join(patterns)}) ", f" {' '.join(words)} "):
            more.add(label)
            best = 1.0
    for label, texts in license_scan.TEMPLATES.items():
        for t, needs in texts:
            span, ws = license_scan.span_of(t), set(license_scan.words_of(t))
            for i in range(len(words) if len(ws & set(words)) >= 0.8 * len(ws) else 0):
                block = words[i : i + span]
                share = len(ws & set(block)) / len(ws)
                if share >= 0.8 and all(f" {p} " in f" {' '.join(block)} " for p in needs):
                    more.add(label)
                    best = max(best, share)
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if places else best


def test_license_scan_matches_brute_force(spark):
    texts = [None, "", "...", "Released under the MIT License.", "under the\nMIT-license under the mit license", "cc-by-nc cc by nc CC BY NC 4.0", "Licensed under the Apache License, Version 2.0.\nx\nThis work is licensed under the GNU General Public License, version 3.", "under the mit licenses", "thunder the mit license", "ünder the mit license", "under the miT license", "under the mit licenſe \u212a K", "permission granted free of charge to any person obtaining a copy of this software and associated documentation files hereby is", "a " * 5000 + "under the mit license", "0 under_the_mit_license 9", "\x00under\x1fthe\x7fmit license\u3000"]
    texts += ["\n".join(textwrap.wrap(t, width, initial_indent=sign, subsequent_indent=sign)) for ts in license_scan.TEMPLATES.values() for t, _ in ts for width, sign in ((75, "# "), (50, " * "))]
    texts += ["some text\n" * 30 + texts[-3] + "\nmore text" * 30, texts[-4].replace("\n", "\n\n\n\n\n\n\n\n\n\n\n"), texts[-4].replace("\n", " ") * 3]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(3, texts[3], "q"), (None, "cc by nc", "q")], "doc_id long, text string, w string")
    got = license_scan.scan(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute("cc by nc" if r.doc_id is None else texts[r.doc_id])
        assert tuple(r)[1:-1] == want[:-1] and r.score == pytest.approx(want[-1])
    assert license_scan.scan(df.limit(0)).count() == 0
    by = {r.doc_id: r.labels for r in got}
    for i, t in enumerate(texts):  # real headers are wrapped
        if t and t.startswith(("# ", " * ")):
            assert by[i]
    none = {r.doc_id: r for r in license_scan.scan(df, templates={}, names={}).collect()}
    assert none[3].labels == none[3].base_labels == "mit" and none[6].labels == none[6].base_labels == "apache-2" and none[12].score == 0
    with pytest.raises(ValueError):
        license_scan.scan(df, phrases={"a b a": "x"})


LINES = {
    "released under the BSD license": "bsd", "Licensed under CC BY 4.0": "cc-by", "Creative Commons Attribution 4.0 International License": "cc-by", "Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "Licensed under the Mozilla License, Version 2.0": "mpl-2", "Licensed under the GNU Affero General Public License, version 2.0": "", "Licensed under the GNU Affero General Public License, version 3": "agpl-3", "This work is licensed under the GNU General Public License, version 2": "gpl-2",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3", "licensed under the GNU Lesser General Public License, version 2.1": "lgpl-2.1", "They released\nthe prisoners\nunder a truce;\nthe\nlicense of poets": "", "Licensed under CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa", "cc by sa 3.0": "cc-by-sa", "Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "SPDX-License-Identifier: Apache-2.0": "apache-2", "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: BSD-3-Clause": "bsd-3", "the three-clause BSD license": "bsd-3", "under the revised BSD licence": "bsd-3", "GPLv3 code": "gpl-3", "LGPL 2.1": "lgpl-2.1", "Released under the Expat License": "mit", "the apache tribe": "", "a licence to kill": "",
    "Licensed under the Apache License, Version 1.1": "", "Eclipse Public License, version 2.0": "", "Mozilla Public License, version 1.1": "", "under the MIT-like license": "",
}


def test_names_tell_licenses_apart(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    assert {texts: r.labels for texts, r in zip(LINES, license_scan.scan(df).orderBy("doc_id").collect(), strict=True)} == LINES


def test_paragraphs_tell_versions_apart(spark):
    texts = {label: t for label, ts in license_scan.TEMPLATES.items() for t, _ in ts[:1]}
    three, two = texts["gpl-3-or-later"], texts["lgpl-2.1-or-later"]
    df = spark.createDataFrame([(0, three.replace("version 3", "version 4")), (1, two.replace("Lesser ", "Library ")), (2, three), (3, "\n * ".join(textwrap.wrap(two, 30))), (4, three.replace("Foundation", "word " * 200))], "doc_id long, text string")
    assert [r.labels for r in license_scan.scan(df).orderBy("doc_id").collect()] == ["", "", "gpl-3-or-later", "lgpl-2.1-or-later", ""]
