"""The corpus operators as queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat_format, exact_dedup, lang_id, license_scan, lm_score, multiset_fp, packing, prefix_trie, simhash, spelling, substring_dedup, url_filter
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document that its path names (/language/doc_id)."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    named = F.regexp_extract(url_filter.path_of(F.col("url")), r"^/[a-z]+/(\d+)", 1).try_cast("long")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = pages.select("url", named.alias("doc_id")).join(labels, "doc_id").select("url", bad.alias("bad"))
    # Sums of doubles vary in their last digits; 0.0 + takes a zero's sign away.
    return url_filter.judge(pages, outcomes).withColumn("bad_bound", F.lit(0.0) + F.round("bad_bound", 6))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat_format.format_chats(turns).withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("learned", chat_format.learned_text(F.col("formatted"), F.col("loss_spans")))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return lm_score.score(table(spark, sf_dir, "documents"), labels)


def op6_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_fp.compare(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = lang_id.identify(docs.select("doc_id", "text"), lang_id.train(docs))
    return judged.select("doc_id", lang_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_url_filter, op3_chat_format, op4_simhash, op5_lm_score, op6_multiset_fingerprint, op7_license_scan, op8_bpe_codec, op9_language_id, op10_packing, op11_spelling, op12_substring_dedup, op13_prefix_trie, pipeline)}


OP1_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) AS rn FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""


UPPER_LOWER = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"


def _rules_sql() -> str:
    rows = ", ".join(f"('{act}', '{h}', '{p}')" for act, h, p in url_filter.RULES)
    return f"""
r AS (SELECT action, host AS h, path AS p FROM (VALUES {rows}) t(action, host, path)),
fits AS (SELECT page_id, host, path, h || p AS rule, action FROM urls, r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
longest AS (SELECT DISTINCT ON (page_id, host, path) page_id, host, path, rule, action FROM fits ORDER BY page_id, host, path, length(rule) DESC, rule)"""


def _shrunk_sql(level: str, above: str, on: str) -> str:
    """Posteriors a, b of a level under priors centred on the level above, by the method of moments."""
    w1, w2 = url_filter.WEIGHTS
    return f"""
{level}_m AS (SELECT l.*, u.a / (u.a + u.b) AS m FROM {level} l JOIN {above} u ON {on}),
{level}_s AS (SELECT sum((k - n * m) * (k - n * m) - n * m * (1 - m)) AS spread, sum(n * (n - 1) * m * (1 - m)) AS room FROM {level}_m),
{level}_w AS (SELECT CASE WHEN room > 0 AND spread > 0 THEN greatest({w1}, least({w2}, room / spread - 1)) ELSE {w2} END AS w FROM {level}_s),
{level}_p AS (SELECT {level}_m.*, m * w + k AS a, (1 - m) * w + n - k AS b FROM {level}_m, {level}_w)"""


_HOST = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {UPPER_LOWER})"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
#: Host without its port; how many labels its suffix has.
_NAME = "regexp_replace(host, ':[0-9]*$', '')"
_NUMERIC = f"regexp_matches({_NAME}, '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$|^\\[.*\\]$')"
_TWO = " OR ".join(f"ends_with({_NAME}, '.{s}')" for s in url_filter.SUFFIXES)
_SUFFIX = f"CASE WHEN {_NUMERIC} THEN '{url_filter.NUMERIC}' WHEN {_TWO} THEN regexp_extract({_NAME}, '[^.]*[.][^.]*$') ELSE regexp_extract({_NAME}, '[^.]*$') END"
_DOMAIN = f"CASE WHEN {_NUMERIC} THEN {_NAME} WHEN {_TWO} THEN regexp_extract({_NAME}, '(?:[^.]*[.])?[^.]*[.][^.]*$') ELSE regexp_extract({_NAME}, '(?:[^.]*[.])?[^.]*$') END"

_MEAN = "({0}.a / ({0}.a + {0}.b))"

OP2_SQL = f"""
WITH urls AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
outcomes AS (SELECT host, quality = 0 OR toxic = 1 AS bad FROM urls JOIN labels ON TRY_CAST(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS BIGINT) = doc_id),
h AS (SELECT host, {_DOMAIN} AS domain, {_SUFFIX} AS suffix, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE bad) AS DOUBLE) AS k FROM outcomes WHERE bad IS NOT NULL GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
every AS (SELECT coalesce(sum(k), 0) + 0.5 AS a, coalesce(sum(n), 0) - coalesce(sum(k), 0) + 0.5 AS b FROM s),
{_shrunk_sql("s", "every", "true")}, {_shrunk_sql("d", "s_p", "l.suffix = u.suffix")}, {_shrunk_sql("h", "d_p", "l.domain = u.domain")},
names AS (SELECT DISTINCT host, {_DOMAIN} AS domain, {_SUFFIX} AS suffix FROM urls),
post AS (SELECT names.host, coalesce(h_p.a, {_MEAN.format("d_p")} * h_w.w, {_MEAN.format("s_p")} * least(h_w.w, d_w.w), {_MEAN.format("every")} * least(h_w.w, d_w.w, s_w.w)) AS a,
  coalesce(h_p.b, (1 - {_MEAN.format("d_p")}) * h_w.w, (1 - {_MEAN.format("s_p")}) * least(h_w.w, d_w.w), (1 - {_MEAN.format("every")}) * least(h_w.w, d_w.w, s_w.w)) AS b
  FROM names LEFT JOIN h_p ON h_p.host = names.host LEFT JOIN d_p ON d_p.domain = names.domain LEFT JOIN s_p ON s_p.suffix = names.suffix, every, h_w, d_w, s_w),
bounds AS (SELECT host, a / (a + b) - {url_filter.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM post),{_rules_sql()}
SELECT u.page_id, u.host, u.path, l.rule, coalesce(l.action, CASE WHEN bound > {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, 0.0 + round(bound, 6) AS bad_bound
FROM urls u JOIN bounds ON bounds.host = u.host LEFT JOIN longest l ON l.page_id IS NOT DISTINCT FROM u.page_id AND l.host = u.host AND l.path = u.path
"""

_HEADS = len(chat_format.OPEN + chat_format.ROLE + chat_format.END_ROLE + chat_format.CLOSE)
_ESCAPED = "regexp_replace({c}, '([<\\[])(~*)" + chat_format.CONTROL + "', '\\1~\\2\\3', 'g')"

OP3_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
e AS (SELECT *, {_ESCAPED.format(c="role")} AS r, {_ESCAPED.format(c="text")} AS t FROM c),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w IS DISTINCT FROM role AS fresh FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{chat_format.LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = '{chat_format.LEARNED}'), '')) AS loss_sha256,
  CAST(sum(length(t) + CASE WHEN fresh THEN length(r) + {_HEADS} ELSE {len(chat_format.SEP)} END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


def _license_sql() -> str:
    """Every place of every phrase, every name, and every block of every template."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    places = " UNION ALL ".join(f"SELECT doc_id, pos, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"coalesce(w[i + {k}] = '{x}', false)" for k, x in enumerate(license_scan.words_of(phrase))) + ")) - 1 AS start FROM d" for phrase, label in license_scan.PHRASES.items())
    names = " UNION ALL ".join(f"SELECT pos, '{label}' AS label, 1.0 AS share FROM d WHERE regexp_matches(t, ' (?:{'|'.join(patterns)}) ')" for label, patterns in license_scan.NAMES.items())
    flat = [(label, sorted(set(license_scan.words_of(text))), license_scan.span_of(text), [f" {p} " for p in needs]) for label, texts in license_scan.TEMPLATES.items() for text, needs in texts]
    templates = ", ".join(f"('{label}', {ws}, {span}, CAST({needs} AS VARCHAR[]))" for label, ws, span, needs in flat)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS pos, {words} AS w, ' ' || array_to_string({words}, ' ') || ' ' AS t FROM documents),
places AS ({places}),
base AS (SELECT doc_id, pos, count(*) AS n, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY 1, 2),
templates AS (SELECT * FROM (VALUES {templates}) v(label, words, span, needs)),
whole AS (SELECT pos, w, label, words, span, needs FROM d, templates WHERE len(list_intersect(w, words)) >= ceil({license_scan.THRESHOLD} * len(words) - 1e-9)),
blocks AS (SELECT pos, label, words, needs, list_slice(w, i, i + span - 1) AS b FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM whole)),
found AS (SELECT pos, label, len(list_intersect(b, words)) / CAST(len(words) AS DOUBLE) AS share, ' ' || array_to_string(b, ' ') || ' ' AS t, needs FROM blocks WHERE len(list_intersect(b, words)) >= ceil({license_scan.THRESHOLD} * len(words) - 1e-9)),
every AS (SELECT pos, label, share FROM found WHERE len(list_filter(needs, lambda p: NOT contains(t, p))) = 0 UNION ALL {names}),
more AS (SELECT pos, list(DISTINCT label) AS labels, max(share) AS share FROM every GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(base.n, 0) AS n_base, base.first_word, base.last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels, CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(more.share, 0.0) END AS score
FROM d LEFT JOIN base ON base.pos = d.pos LEFT JOIN more ON more.pos = d.pos
"""


def _crc32_sql(text: str) -> str:
    """Half a byte at a time, by a table of sixteen remainders."""
    table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    nibbles = f"flatten(list_transform(range(0, octet_length(encode({text})) * 2, 2), lambda i: [CAST('0x' || substr(hex(encode({text})), CAST(i + 2 AS BIGINT), 1) AS BIGINT), CAST('0x' || substr(hex(encode({text})), CAST(i + 1 AS BIGINT), 1) AS BIGINT)]))"
    return f"xor(list_reduce(list_concat([CAST({2**32 - 1} AS BIGINT)], {nibbles}), lambda c, b: xor(c >> 4, ({table})[(xor(c, b) & 15) + 1])), CAST({2**32 - 1} AS BIGINT))"


OP11_SQL = f"""
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, {UPPER_LOWER}), '{spelling.LETTERS}')) AS w FROM documents),
each AS (SELECT id, w, count(*) AS k FROM runs WHERE length(w) >= {spelling.LEAST_CHARS} GROUP BY 1, 2),
marked AS (SELECT w, k, {_crc32_sql("id || ':' || w")} AS h FROM each),
slipped AS (SELECT k, CASE WHEN h % {spelling.SLIPS} = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS word FROM marked),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY 1 HAVING sum(k) >= {spelling.LEAST_COUNT}),
rests AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
indels AS (SELECT DISTINCT word, rest FROM rests WHERE rest IN (SELECT word FROM v)),
pairs AS (SELECT x.word, y.word AS other FROM rests x JOIN rests y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION ALL SELECT word, rest FROM indels UNION ALL SELECT rest, word FROM indels),
best AS (SELECT pairs.word, count(*) AS n_near, arg_min(struct_pack(o := other, m := v.n), struct_pack(m := -v.n, o := encode(other))) AS b FROM pairs JOIN v ON v.word = other GROUP BY 1),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.m >= {spelling.RATIO} * v.n THEN b.o END AS form, CASE WHEN b.m >= {spelling.RATIO} * v.n THEN b.m END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
follow AS (SELECT word, word AS at FROM forms UNION ALL SELECT follow.word, forms.form FROM follow JOIN forms ON forms.word = follow.at WHERE forms.form IS NOT NULL),
last AS (SELECT follow.word, follow.at AS root FROM follow JOIN forms ON forms.word = follow.at WHERE forms.form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN last ON last.word = forms.word
"""

#: Every window of every text, by its words.
OP12_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, hash(w[i:i + {substring_dedup.WINDOW - 1}]) AS h, md5(array_to_string(w[i:i + {substring_dedup.WINDOW - 1}], ' ')) AS m FROM (SELECT *, unnest(range(1, len(w) - {substring_dedup.WINDOW - 2})) AS i FROM d)),
counted AS (SELECT r, i, count(*) OVER (PARTITION BY h, m) AS n FROM windows),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {substring_dedup.WINDOW})) AS i FROM counted WHERE n > 1),
kept AS (SELECT r, count(*) AS k, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) x ANTI JOIN gone USING (r, i) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r
"""

_CONV = prefix_trie.EVERY
OP13_SQL = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM own),
convs AS (SELECT c, c - c % {_CONV} AS base, {_crc32_sql("CAST(c AS VARCHAR)")} % {prefix_trie.TURNS} AS h FROM ids),
turns AS (SELECT convs.c, i, r, t FROM own JOIN convs ON convs.base = own.c WHERE i <= h UNION ALL SELECT own.c, i, r, t FROM own JOIN convs ON convs.c = own.c WHERE i > h),
seqs AS (SELECT convs.c, coalesce(list(struct_pack(r := r, t := t) ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS s FROM convs LEFT JOIN turns ON turns.c = convs.c GROUP BY 1),
paths AS (SELECT c, len(s) = d AS ends, d, s[1:d] AS p, octet_length(encode(coalesce(s[d].t, ''))) AS bytes FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(CASE WHEN d = 0 THEN 0 ELSE bytes END) AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM paths GROUP BY d, p),
children AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1, 2),
above AS (SELECT n.p[1:a] AS p, a AS d, n.own, c.k IS NULL AS leaf FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM nodes) n LEFT JOIN children c ON c.d = n.d AND c.p = n.p),
sums AS (SELECT d, p, sum(own) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM above GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.k, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.p[1:n.d - 1] LEFT JOIN children c ON c.d = n.d AND c.p = n.p JOIN sums s ON s.d = n.d AND s.p = n.p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_url_filter": OP2_SQL, "op3_chat_format": OP3_SQL, "op7_license_scan": _license_sql(), "op11_spelling": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
