"""The catalogue's operators bound to the star-schema test tables, each with the same query in SQL.

Every binding runs over its whole tables; limits stand only where the operator is a top-k."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text, web, when
from ..functions import hours as H
from ..operators import facets, lifecycle, match, rank, routes, search, upsert
from ..sources import markup
from ..streaming import queue

AS_OF = "2024-01-20 12:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share; without spark.checkpoint.dir only on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tidewell"
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


# --- ranks -----------------------------------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT doc_id, lower(trim(text)) AS k, n_chars, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id) AS labelled FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY labelled DESC, n_chars DESC NULLS LAST, doc_id DESC) AS rn FROM d)
SELECT doc_id, labelled, n_chars, rn > 1 AS archived, CASE WHEN rn > 1 THEN 'duplicate' END AS archive_reason FROM r
""")
def dedup_keep_best(spark, d):
    docs = match.flagged(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id", "labelled")
    # Groups are told apart by a 256-bit digest, so texts need not be sorted or shuffled.
    keyed = docs.select("doc_id", "labelled", "n_chars", F.sha2(F.lower(F.trim("text")), 256).alias("k"))
    return rank.mark_duplicates(keyed, ["k"], [F.desc("labelled"), F.desc_nulls_last("n_chars"), F.desc("doc_id")], key="doc_id").drop("k")


@query("SELECT md5(lower(trim(text))) AS key, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, d):
    keyed = t(spark, d, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@query("SELECT doc_id, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id DESC LIMIT 100")
def anti_missing(spark, d):
    return match.missing(t(spark, d, "documents").select("doc_id", "source", "n_chars"), t(spark, d, "labels"), "doc_id", [F.desc("doc_id")], 100)


@query("""
WITH r AS (SELECT event_id, user_id, event_type, round(value, 4) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT event_id, user_id, event_type, value, CAST(rn AS INTEGER) AS turn FROM r WHERE rn <= 3
""")
def last_three(spark, d):
    e = t(spark, d, "events")
    return rank.first_n(e, ["user_id"], [F.desc_nulls_last("ts"), F.desc("event_id")], 3, "turn").select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"), "turn")


@query("SELECT user_id, event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS seen FROM events GROUP BY 1, 2 ORDER BY max(ts) DESC, user_id, event_type LIMIT 400")
def seen_fifo(spark, d):
    return rank.recent_distinct(t(spark, d, "events"), ["user_id", "event_type"], "ts", 400).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query("""
WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn FROM supplier)
SELECT s_suppkey, s_nationkey, CAST(turn AS INTEGER) AS turn FROM r ORDER BY turn, s_nationkey LIMIT 20
""")
def round_robin(spark, d):
    return rank.round_robin(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", [F.asc("s_suppkey")], 20)


@query(f"SELECT o_orderkey, 'in_progress' AS status FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE) ORDER BY (o_orderstatus <> 'O'), o_orderkey LIMIT 1")
def queue_claim(spark, d):
    status = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("done")
    queue_ = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("claimed_at"))
    return lifecycle.claim(queue_, now()).select(F.col("id").alias("o_orderkey"), "status")


@query("""
WITH e AS (SELECT event_id, CAST(date_part('hour', ts) * 60 + date_part('minute', ts) AS INTEGER) AS minutes, CASE WHEN user_id % 7 <> 0 THEN round(value, 2) END AS metres FROM events)
SELECT event_id, minutes, metres FROM e ORDER BY minutes ASC NULLS LAST, metres ASC NULLS LAST, event_id LIMIT 500
""")
def soonest_then_nearest(spark, d):
    e = t(spark, d, "events").select("event_id", (F.hour("ts") * 60 + F.minute("ts")).alias("minutes"), F.when(F.col("user_id") % 7 != 0, F.round("value", 2)).alias("metres"))
    return rank.top_k(e, rank.soonest_then_nearest("minutes", "metres", "event_id"), 500)


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 99 END, o_orderkey LIMIT 20 OFFSET 40")
def fixed_order_page(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return rank.page(o, [rank.by_fixed_order(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]), F.asc("o_orderkey")], 2)


# --- lifecycle -------------------------------------------------------------------------------------------------------


@query("""
WITH last AS (SELECT c.c_custkey, n.n_name, max(o.o_orderdate) AS seen FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2),
a AS (SELECT n_name, c_custkey, row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) AS rn FROM last WHERE seen < (SELECT max(o_orderdate) FROM orders) - INTERVAL 120 DAY)
SELECT n_name, count(*) AS absent, string_agg(CASE WHEN rn <= 50 THEN CAST(c_custkey AS VARCHAR) END, ',' ORDER BY c_custkey) AS ids FROM a GROUP BY 1
""")
def absent_reconcile(spark, d):
    c, o, n = (t(spark, d, x) for x in ("customer", "orders", "nation"))
    seen = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("seen"))
    rows = c.join(seen, "c_custkey").join(n, c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(o.agg(F.max("o_orderdate").alias("latest"))))
    return lifecycle.absent(rows, ["n_name"], "c_custkey", "seen", F.col("latest"), 120).select("n_name", "absent", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


ZERO = """
WITH r AS (SELECT user_id, ts, {idle} AS idle, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')
SELECT user_id, count(*) AS runs, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run FROM r WHERE rn <= 3 GROUP BY 1 HAVING count(*) = 3 AND bool_and(idle)
"""


def _zero(spark, d, idle):
    since = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return lifecycle.zero_yield(t(spark, d, "events"), "user_id", "ts", "event_id", idle, since).select("user_id", "runs", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@query(ZERO.format(idle="value < 60"))
def zero_yield_last3(spark, d):
    return _zero(spark, d, F.col("value") < 60)


@query(ZERO.format(idle="coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) < 70"))
def zero_yield_json(spark, d):
    return _zero(spark, d, F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)) < 70)


@query("""
WITH l AS (SELECT event_id, user_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_type FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM l WHERE old_type IS DISTINCT FROM event_type)
SELECT user_id, event_id, old_type, event_type AS new_type FROM c WHERE rn = 1
""")
def latest_change(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_first("ts"), "event_id")
    changed = t(spark, d, "events").withColumn("old_type", F.lag("event_type").over(w)).where(~F.col("old_type").eqNullSafe(F.col("event_type")))
    return rank.keep_best(changed, ["user_id"], [F.desc_nulls_last("ts"), F.desc("event_id")]).select("user_id", "event_id", "old_type", F.col("event_type").alias("new_type"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' OR o_orderdate IS NULL")
def purge_age(spark, d):
    return upsert.purge(t(spark, d, "orders"), "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'expired' END AS archive_reason FROM orders")
def soft_archive(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return upsert.update_where(o, F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"), {"o_orderstatus": F.lit("F"), "archive_reason": F.lit("expired")}).drop("o_orderdate")


@query("SELECT event_id, CASE WHEN TIMESTAMP '2024-01-20 12:00:00' < ts + INTERVAL 5 DAY THEN 'fresh' WHEN TIMESTAMP '2024-01-20 12:00:00' < ts + INTERVAL 12 DAY THEN 'stale' ELSE 'expired' END AS state FROM events")
def swr_state(spark, d):
    ts = F.col("ts")
    return t(spark, d, "events").select("event_id", when.freshness(now(), ts + F.expr("INTERVAL 5 DAY"), ts + F.expr("INTERVAL 12 DAY")).alias("state"))


# --- facets and aggregates -------------------------------------------------------------------------------------------


@query("SELECT 'p_type' AS facet, p_type AS value, count(*) FILTER (WHERE p_size <= 15 AND p_retailprice < 1500) AS n FROM part GROUP BY 2")
def facet_counts_zero(spark, d):
    return facets.facet_counts(t(spark, d, "part"), ["p_type"], {"size": F.col("p_size") <= 15, "price": F.col("p_retailprice") < 1500})


@query("""
SELECT 'p_type' AS facet, p_type AS value, count(*) FILTER (WHERE p_size <= 25 AND p_brand IN ('Brand#1', 'Brand#11', 'Brand#23')) AS n FROM part GROUP BY 2
UNION ALL SELECT 'p_brand', p_brand, count(*) FILTER (WHERE p_size <= 25 AND p_type LIKE '%A%') FROM part GROUP BY 2
""")
def facet_self_excluding(spark, d):
    chain = {"size": F.col("p_size") <= 25, "p_brand": F.col("p_brand").isin("Brand#1", "Brand#11", "Brand#23"), "p_type": F.col("p_type").contains("A")}
    return facets.facet_counts(t(spark, d, "part"), ["p_type", "p_brand"], chain)


@query("""
WITH axis AS (SELECT CAST(DATE '2024-01-26' + CAST(i AS INTEGER) AS DATE) AS date FROM range(7) r(i)),
c AS (SELECT a.date, count(e.event_id) AS n FROM axis a LEFT JOIN events e ON CAST(e.ts AS DATE) = a.date GROUP BY 1)
SELECT date, n, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(4, round(n / max(n) OVER () * 34)) END AS INTEGER) AS height FROM c
""")
def density_week(spark, d):
    dated = t(spark, d, "events").select(F.to_date("ts").alias("date"))
    return facets.strip(dated, "date", F.lit("2024-01-26").cast("date"))


@query("""
WITH e AS (SELECT CAST(ts AS DATE) AS d FROM events)
SELECT count(*) FILTER (WHERE d = DATE '2024-01-20') AS tonight, count(*) FILTER (WHERE d = DATE '2024-01-21') AS tomorrow,
count(*) FILTER (WHERE d IN (DATE '2024-01-20', DATE '2024-01-21')) AS weekend, count(*) FILTER (WHERE d BETWEEN DATE '2024-01-20' AND DATE '2024-01-26') AS thisweek, count(*) AS anytime FROM e
""")
def when_windows(spark, d):
    today = F.lit(AS_OF[:10]).cast("date")
    dated = t(spark, d, "events").select(F.to_date("ts").alias("d"))
    names = ("tonight", "tomorrow", "weekend", "thisweek", "anytime")
    return facets.window_counts(dated, {w: when.matches_window(w, F.col("d"), today) for w in names})


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn FROM c)
SELECT k.c_nationkey, coalesce(r.c_mktsegment, 'none') AS c_mktsegment FROM (SELECT DISTINCT c_nationkey FROM customer) k LEFT JOIN r ON r.c_nationkey = k.c_nationkey AND rn = 1
""")
def mode_with_fallback(spark, d):
    return facets.mode(t(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "none", ["BUILDING"])


@query("""
WITH v AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS likes, count(*) FILTER (WHERE event_type = 'error') AS dislikes FROM events GROUP BY 1)
(SELECT 'likes' AS list, user_id, likes AS n FROM v WHERE likes > 0 ORDER BY likes DESC, user_id LIMIT 10)
UNION ALL (SELECT 'dislikes', user_id, dislikes FROM v WHERE dislikes > 0 ORDER BY dislikes DESC, user_id LIMIT 10)
""")
def vote_tally(spark, d):
    v = facets.tally(t(spark, d, "events"), "user_id", "event_type", {"likes": "click", "dislikes": "error"})
    lists = [rank.top_k(v.where(F.col(x) > 0), [F.desc(x), F.asc("user_id")], 10).select(F.lit(x).alias("list"), "user_id", F.col(x).alias("n")) for x in ("likes", "dislikes")]
    return lists[0].unionByName(lists[1])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, d):
    return facets.histogram(t(spark, d, "orders"), "o_orderstatus")


@query("SELECT s_nationkey, string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) AS ids, count(*) AS n FROM supplier GROUP BY 1")
def group_collect_ids(spark, d):
    return facets.collected(t(spark, d, "supplier"), ["s_nationkey"], "s_suppkey").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""
WITH c AS (SELECT count(*) FILTER (WHERE p_retailprice < 1000 AND p_size = 7) AS brand, count(*) FILTER (WHERE p_brand = 'Brand#1' AND p_size = 7) AS price, count(*) FILTER (WHERE p_brand = 'Brand#1' AND p_retailprice < 1000) AS size FROM part)
SELECT * FROM (SELECT unnest(['brand', 'price', 'size']) AS "drop", unnest([brand, price, size]) AS n FROM c) WHERE n > 0 ORDER BY n DESC, "drop" LIMIT 1
""")
def looser_filter(spark, d):
    return facets.looser_filter(t(spark, d, "part"), {"brand": F.col("p_brand") == "Brand#1", "price": F.col("p_retailprice") < 1000, "size": F.col("p_size") == 7})


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey) AS suppliers, strftime(max(l_shipdate), '%Y-%m-%d') AS freshest FROM lineitem")
def exact_counts(spark, d):
    return t(spark, d, "lineitem").agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_suppkey").alias("suppliers"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("freshest"))


# --- places ----------------------------------------------------------------------------------------------------------

PLACED = "SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 9 <> 0 THEN 59.40 + (s_suppkey % 50) * 0.002 END AS lat, 24.65 + (s_suppkey % 71) * 0.003 AS lng FROM supplier"
HAVERSINE = "2 * 6371000.0 * asin(sqrt(pow(sin(radians({b_lat} - {a_lat}) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians({b_lng} - {a_lng}) / 2), 2)))"


def placed(spark, d):
    s, k = t(spark, d, "supplier"), F.col("s_suppkey")
    return s.select("s_suppkey", "s_nationkey", F.when(k % 9 != 0, 59.40 + (k % 50) * 0.002).alias("lat"), (24.65 + (k % 71) * 0.003).alias("lng"))


@query(f"WITH p AS ({PLACED}), m AS (SELECT s_suppkey, round({HAVERSINE.format(a_lat='59.437', a_lng='24.7536', b_lat='lat', b_lng='lng')}, 2) AS metres FROM p) SELECT s_suppkey, metres, CAST(greatest(1, round(metres / 80)) AS INTEGER) AS walk FROM m WHERE metres IS NULL OR metres <= 4000")
def haversine_within(spark, d):
    m = placed(spark, d).select("s_suppkey", F.round(geo.haversine(F.lit(59.437), F.lit(24.7536), F.col("lat"), F.col("lng")), 2).alias("metres"))
    return m.where(geo.within(F.col("metres"), F.lit(4000))).withColumn("walk", geo.walk_minutes(F.col("metres")))


SQL["haversine_within"] = SQL["haversine_within"].replace("CAST(greatest(1, round(metres / 80)) AS INTEGER)", "CASE WHEN metres IS NOT NULL THEN CAST(greatest(1, round(metres / 80)) AS INTEGER) END")


@query(f"WITH p AS ({PLACED}) SELECT s_suppkey FROM p WHERE lat BETWEEN 59.42 AND 59.47 AND lng BETWEEN 24.70 AND 24.80")
def bbox_clip(spark, d):
    return placed(spark, d).where(geo.in_box(F.col("lat"), F.col("lng"), 59.42, 24.70, 59.47, 24.80)).select("s_suppkey")


@query(f"WITH p AS ({PLACED}) SELECT CAST(round(min(lat), 4) AS DOUBLE) AS south, CAST(round(min(lng), 4) AS DOUBLE) AS west, CAST(round(max(lat), 4) AS DOUBLE) AS north, CAST(round(max(lng), 4) AS DOUBLE) AS east FROM p WHERE lat IS NOT NULL")
def bbox_extent(spark, d):
    return facets.extent(placed(spark, d), "lat", "lng").select(*(F.round(c, 4).alias(c) for c in ("south", "west", "north", "east")))


@query(f"""
WITH p AS ({PLACED}), l AS (SELECT *, lag(lat) OVER w AS a_lat, lag(lng) OVER w AS a_lng, lag(s_suppkey) OVER w AS before FROM p WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
m AS (SELECT *, {HAVERSINE.format(a_lat='a_lat', a_lng='a_lng', b_lat='lat', b_lng='lng')} AS metres FROM l),
s AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN metres IS NULL THEN 23 ELSE greatest(1, round(metres / 80)) + 15 END AS step FROM m)
SELECT s_nationkey, s_suppkey, round(metres, 2) AS metres, CAST(sum(step) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS after FROM s
""")
def walk_route(spark, d):
    return routes.legs(placed(spark, d), "s_nationkey", "s_suppkey").select("s_nationkey", "s_suppkey", F.round("metres", 2).alias("metres"), "after")


@query("""
WITH v AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, 600 + s_suppkey % 60 AS opens, 900 + (s_suppkey % 13) * 45 AS closes FROM supplier),
w AS (SELECT v.*, k AS step, 700 + k * 10 + i * 23 AS m FROM v, range(73) r(k)),
o AS (SELECT s_nationkey, step, bool_and(m >= opens AND m < closes) AS ok FROM w GROUP BY 1, 2),
f AS (SELECT s_nationkey, coalesce(min(step) FILTER (WHERE NOT ok) - 1, 72) AS last FROM o GROUP BY 1)
SELECT s_nationkey, CASE WHEN last >= 0 THEN CAST(700 + last * 10 AS INTEGER) END AS leave_by FROM f
""")
def leave_by(spark, d):
    s = t(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    span = F.struct((600 + F.col("s_suppkey") % 60).cast("int").alias("open"), (900 + (F.col("s_suppkey") % 13) * 45).cast("int").alias("close"))
    week = F.struct(F.array_repeat(F.array(span), 7).alias("week"), F.lit(None).cast("array<struct<open:int,close:int>>").alias("ph"))
    return routes.leave_by(routes.legs(s, "s_nationkey", "s_suppkey").withColumn("hours", week), "s_nationkey", "s_suppkey", 700, 2)


# --- search ----------------------------------------------------------------------------------------------------------

SEARCH = ["that", "from"]


def _text_sql(words: list[str], limit: int) -> str:
    tf = ", ".join(f"CAST(len(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x = '{w}')) AS DOUBLE) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} / (tf{i} + 1)" for i in range(len(words)))
    every = " AND ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"f AS (SELECT doc_id, {tf} FROM documents), g AS (SELECT count(*) AS n, {df} FROM f), s AS (SELECT doc_id, round({score}, 6) AS score FROM f, g WHERE {every}), words AS (SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s ORDER BY score DESC, doc_id LIMIT {limit})"


def _vector_sql(limit: int) -> str:
    # The 0.0 + keeps a zero's sign out of the comparison.
    return f"q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), c AS (SELECT vec_id AS doc_id, 0.0 + round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS distance FROM embeddings, q), vectors AS (SELECT doc_id, distance, CAST(row_number() OVER (ORDER BY distance, doc_id) AS INTEGER) AS rank FROM c ORDER BY distance, doc_id LIMIT {limit})"


def _words(spark, d, k):
    docs = t(spark, d, "documents")
    return search.text_rank(docs, "doc_id", [(F.col("text"), 1.0)], " ".join(sorted(SEARCH)), k)


def _vectors(spark, d, k):
    e = t(spark, d, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("v"))  # one row
    rows = e.select(F.col("vec_id").alias("doc_id"), "embedding").join(F.broadcast(q))
    return rank.top_k(rows.select("doc_id", (F.lit(0.0) + F.round(1 - search.cosine(F.col("embedding"), F.col("v")), 6)).alias("distance")), [F.asc_nulls_last("distance"), F.asc("doc_id")], k, "rank")


@query(f"WITH {_text_sql(sorted(SEARCH), 50)} SELECT * FROM words")
def text_rank(spark, d):
    return _words(spark, d, 50)


@query(f"WITH {_vector_sql(50)} SELECT doc_id, rank, round(distance, 4) AS distance FROM vectors")
def cosine_topk(spark, d):
    return _vectors(spark, d, 50).withColumn("distance", F.round("distance", 4))


@query(f"""
WITH {_text_sql(sorted(SEARCH), 50)}, {_vector_sql(50)}
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS r1, b.rank AS r2, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 8) AS score
FROM words a FULL JOIN vectors b ON a.doc_id = b.doc_id ORDER BY score DESC, doc_id LIMIT 20
""")
def rrf_hybrid(spark, d):
    return search.fuse(_words(spark, d, 50), _vectors(spark, d, 50), "doc_id", 20)


TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, CAST(length(w) + 2 AS BIGINT)), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""
WITH g AS (SELECT p_partkey, p_name, p_retailprice, p_brand = 'Brand#1' AS hit, {TRIGRAMS.format(c='p_name')} AS a, {TRIGRAMS.format(c="'kind ' || p_type || ' 12'")} AS c, {TRIGRAMS.format(c="'part 12'")} AS b FROM part),
s AS (SELECT *, len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) AS by_name, len(list_intersect(c, b)) / CAST(len(list_distinct(list_concat(c, b))) AS DOUBLE) AS by_kind FROM g),
r AS (SELECT p_partkey, p_name, p_retailprice, round(greatest(by_name, by_kind) + CASE WHEN hit THEN 0.35 ELSE 0.0 END + 0.1 * (p_retailprice / 10000), 6) AS score FROM s WHERE by_name >= 0.3 OR by_kind >= 0.3 OR hit)
SELECT p_partkey, p_name, score FROM r ORDER BY score DESC, p_retailprice / 10000 DESC NULLS LAST, p_partkey LIMIT 50
""")
def trigram_search(spark, d):
    p = t(spark, d, "part").withColumns({"confidence": F.col("p_retailprice") / 10000, "category": F.concat(F.lit("kind "), F.col("p_type"), F.lit(" 12"))})
    return search.fuzzy_places(p, "p_partkey", "p_name", "category", "p_brand", "confidence", "part 12", ["Brand#1"], 50).select("p_partkey", "p_name", "score")


# --- text ------------------------------------------------------------------------------------------------------------

_FILLER = ", ".join(f"'{w}'" for w in text.FILLER)
_WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND NOT list_contains([" + _FILLER + "], w)))"


@query(f"""
WITH p AS (SELECT b.item_id, trim(b.text) AS s, d.text AS title FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id)
SELECT item_id, CASE WHEN length(s) >= 12 AND NOT regexp_matches(s, '(?i)^(tba|tbc|n/a|none|null|-|—)$') AND len(list_filter({_WORDS.format(c='substr(s, 1, 300)')}, lambda w: NOT list_contains({_WORDS.format(c="coalesce(title, '')")}, w))) > 0 THEN md5(s) ELSE '' END AS kept FROM p
""")
def paraphrase_guard(spark, d):
    b, docs = t(spark, d, "benchmark"), t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("title"))
    said = text.says_something(F.col("text"), F.col("title"))
    return b.join(docs, "item_id", "left").select("item_id", F.when(said == "", "").otherwise(F.md5(said)).alias("kept"))


_STRIP = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce({c}, ''), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({_STRIP.format(c='html')}) AS digest, length({_STRIP.format(c='html')}) AS n FROM pages")
def strip_html(spark, d):
    s = text.strip_tags(F.col("html"))
    return t(spark, d, "pages").select("page_id", F.md5(s).alias("digest"), F.length(s).cast("long").alias("n"))


@query(f"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>)', 1)) AS a, generate_subscripts(regexp_extract_all(html, '(?is)(<a\\s[^>]*href="[^"]*"[^>]*>.*?</a>)', 1), 1) AS i FROM pages)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href, {_STRIP.format(c='a')} AS text FROM a
""")
def page_links(spark, d):
    return markup.page_links(t(spark, d, "pages"), "html", ["page_id"])


@query(f"SELECT page_id, {_STRIP.format(c="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages")
def page_titles(spark, d):
    return t(spark, d, "pages").select("page_id", markup.page_title(F.col("html")).alias("title"))


@query("""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)), '^www\\.', '') AS host FROM pages)
SELECT page_id, host, CASE WHEN regexp_matches(host, '(^|\\.)example\\.com$') THEN 'com' WHEN regexp_matches(host, '(^|\\.)example\\.net$') THEN 'net' WHEN regexp_matches(host, '^(blog|m)\\.') THEN 'sub' END AS class FROM h
""")
def host_classify(spark, d):
    h = web.host(F.col("url"))
    kind = F.when(h.rlike(r"(^|\.)example\.com$"), "com").when(h.rlike(r"(^|\.)example\.net$"), "net").when(h.rlike(r"^(blog|m)\."), "sub")
    return t(spark, d, "pages").select("page_id", h.alias("host"), kind.alias("class"))


@query("SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 30) AS slug FROM part")
def slug_key(spark, d):
    return t(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("""
WITH n AS (SELECT doc_id, trim(text) AS s, list_transform(regexp_extract_all(text, '(\\d+(?:[.,]\\d{1,2})?)', 1), lambda x: CAST(replace(x, ',', '.') AS DOUBLE)) AS nums FROM documents),
k AS (SELECT doc_id, nullif(s, '') AS s, regexp_matches(s, '(?i)bezmaksas|free|бесплатно') AS free, nums FROM n)
SELECT doc_id, CASE WHEN free THEN true WHEN len(nums) > 0 THEN false END AS is_free, CASE WHEN NOT free THEN list_min(nums) END AS price_min, CASE WHEN NOT free AND len(nums) > 1 THEN list_max(nums) END AS price_max,
CASE WHEN NOT free AND len(nums) > 0 AND regexp_matches(s, '(?i)€|eur') THEN 'EUR' END AS currency FROM k
""")
def price_parse(spark, d):
    return t(spark, d, "documents").select("doc_id", web.parse_price(F.col("text")).alias("p")).select("doc_id", "p.is_free", "p.price_min", "p.price_max", "p.currency")


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'License' WHEN contains(lower(text), 'password') THEN 'password' WHEN contains(lower(text), 'http') THEN 'http' END AS keyword FROM documents")
def skip_keywords(spark, d):
    return t(spark, d, "documents").select("doc_id", text.first_keyword(F.col("text"), ["License", "password", "http"]).alias("keyword"))


@query("""
WITH f AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' TBA ' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL ELSE c_mktsegment END AS v FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(trim(coalesce(v, '')), '(?i)^(unknown|tba|tbc|n/a|other|none|null|-)$') THEN '' ELSE trim(coalesce(v, '')) END AS shown FROM f
""")
def placeholder_real(spark, d):
    k = F.col("c_custkey") % 5
    v = F.when(k == 0, " TBA ").when(k == 1, "n/a").when(k == 2, None).otherwise(F.col("c_mktsegment"))
    return t(spark, d, "customer").select("c_custkey", text.real_or_empty(v).alias("shown"))


@query("""
WITH p AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal + 10 END AS high FROM customer)
SELECT c_custkey, '€' || CASE WHEN c_acctbal % 1 = 0 THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE printf('%.2f', c_acctbal) END || CASE WHEN high IS NOT NULL AND high <> c_acctbal THEN '–' || CASE WHEN high % 1 = 0 THEN CAST(CAST(high AS BIGINT) AS VARCHAR) ELSE printf('%.2f', high) END ELSE '' END AS label FROM p
""")
def price_labels(spark, d):
    low, high = F.col("c_acctbal"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") + 10)
    return t(spark, d, "customer").select("c_custkey", web.price_label(F.lit(False), low, high, F.lit("EUR")).alias("label"))


# --- joins and sinks -------------------------------------------------------------------------------------------------


@query("SELECT c.c_custkey, n.n_regionkey FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def norm_join(spark, d):
    n = t(spark, d, "nation")
    names = n.select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit(" "), F.upper("n_name"), F.lit(" ")).alias("shown"))
    c = t(spark, d, "customer").join(names, "c_nationkey", "left").select("c_custkey", "shown")
    return match.left_by_name(c, n.select(F.lower("n_name").alias("plain"), "n_regionkey"), "shown", "plain").select("c_custkey", "n_regionkey")


@query("""
WITH e AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS by_id, CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) END AS by_name FROM supplier)
SELECT s_suppkey, CASE WHEN by_id IS NOT NULL THEN by_id * 10 WHEN by_name IS NOT NULL THEN s_suppkey * 100 END AS value, CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_name IS NOT NULL THEN 'name' END AS reason FROM e
""")
def priority_match(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.lower(F.trim("s_name")).alias("norm"))
    by_id = s.where("s_suppkey % 3 = 0").select("s_suppkey", (F.col("s_suppkey") * 10).alias("value"))
    by_name = s.where("s_suppkey % 2 = 0").select("norm", (F.col("s_suppkey") * 100).alias("value"))
    return match.priority_match(s, [("id", by_id, ["s_suppkey"]), ("name", by_name, ["norm"])], "value").select("s_suppkey", "value", "reason")


@query("""
WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(c.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(c.o_orderstatus, b.o_orderstatus) AS o_orderstatus, coalesce(c.o_totalprice, b.o_totalprice) AS o_totalprice FROM b FULL JOIN c ON b.o_orderkey = c.o_orderkey
""")
def full_outer_merge(spark, d):
    return match.merge_sides(*_slices(spark, d), "o_orderkey")


def _slices(spark, d):
    o, k = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    changed = o.where(k % 3 != 1).select("o_orderkey", F.when(k % 2 == 0, "X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return o.where(k % 3 != 0), changed


@query("""
WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(c.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN c.o_orderkey IS NOT NULL THEN c.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus, CASE WHEN c.o_orderkey % 5 = 0 THEN c.o_totalprice ELSE b.o_totalprice END AS o_totalprice FROM b FULL JOIN c ON b.o_orderkey = c.o_orderkey
""")
def upsert_present(spark, d):
    base, changed = _slices(spark, d)
    return upsert.upsert(base, changed, ["o_orderkey"], {"o_totalprice": F.col("o_orderkey") % 5 == 0})


@query("SELECT CAST(count(*) FILTER (WHERE event_id % 4 = 0) AS BIGINT) AS inserted, CAST(count(*) FILTER (WHERE event_id % 2 = 0) * 2 - count(*) FILTER (WHERE event_id % 4 = 0) AS BIGINT) AS skipped FROM events")
def insert_ignore_counts(spark, d):
    e = t(spark, d, "events").select("event_id", "ts")
    again = e.where("event_id % 2 = 0")
    return upsert.insert_ignore(e.where("event_id % 4 <> 0"), again.unionAll(again), ["event_id"], [F.asc_nulls_last("ts")])[1]


@query("""
SELECT o.o_orderkey, CASE WHEN c.c_mktsegment = 'BUILDING' THEN c.c_name ELSE o.o_orderpriority END AS o_orderpriority
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
""")
def update_from(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    c = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return upsert.update_from(o, c, ["c_custkey"], {"o_orderpriority": "c_name"}).drop("c_custkey")


@query("""
WITH a AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT c_custkey, upper(c_name) AS c_name FROM customer WHERE c_nationkey < 10)
SELECT c_custkey, c_name FROM a UNION ALL SELECT c_custkey, c_name FROM b WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM a)
""")
def recipients_union_anti(spark, d):
    c = t(spark, d, "customer")
    return match.union_without(c.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name"), c.where("c_nationkey < 10").select("c_custkey", F.upper("c_name").alias("c_name")), "c_name")


@query("""
WITH o AS (SELECT user_id, event_type AS old_type, value AS old_value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1),
n AS (SELECT user_id, event_type AS new_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)
SELECT user_id, old_type AS old_event_type, new_type AS new_event_type FROM o JOIN n USING (user_id) WHERE old_type IS DISTINCT FROM new_type
""")
def change_journal(spark, d):
    e = t(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    old = rank.keep_best(e, ["user_id"], [F.asc_nulls_last("ts"), F.asc("event_id")])
    new = rank.keep_best(e, ["user_id"], [F.desc_nulls_last("ts"), F.desc("event_id")])
    return upsert.change_journal(old, new, "user_id", ["event_type"], now()).drop("changed_at")


# --- calendar and hours ----------------------------------------------------------------------------------------------


@query("""
SELECT event_id, CAST(date_part('isodow', ts) - 1 AS INTEGER) AS weekday, CAST(date_part('hour', l) * 60 + date_part('minute', l) AS INTEGER) AS minutes, CAST(l AS DATE) AS date
FROM (SELECT event_id, ts, ts + CASE WHEN ts >= TIMESTAMP '2024-03-31 01:00:00' AND ts < TIMESTAMP '2024-10-27 01:00:00' THEN INTERVAL 3 HOUR ELSE INTERVAL 2 HOUR END AS l
  FROM (SELECT event_id, ts + CAST(event_id % 12 AS INTEGER) * INTERVAL 30 DAY AS ts FROM events))
""")
def local_clock(spark, d):
    """Every twelfth event a month further, so that both switches of the clock lie within."""
    ts = F.expr("ts + make_dt_interval(30 * int(event_id % 12))").cast("timestamp")
    return t(spark, d, "events").select("event_id", ts.alias("ts")).select("event_id", F.weekday("ts").alias("weekday"), when.local_minutes(F.col("ts")).alias("minutes"), when.local_date(F.col("ts")).alias("date"))


@query("""
WITH y AS (SELECT DISTINCT CAST(date_part('year', o_orderdate) + o_custkey % 70 AS INTEGER) AS y FROM orders),
p AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), q AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM p),
r AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM q), s AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM r)
SELECT y AS year, make_date(CAST(y AS BIGINT), CAST(n // 31 AS BIGINT), CAST(n % 31 + 1 AS BIGINT)) AS easter FROM s
""")
def easter(spark, d):
    """Of the orders' years and of up to seventy years later, by the customer."""
    years = t(spark, d, "orders").select((F.year("o_orderdate") + F.col("o_custkey") % 70).cast("int").alias("year")).distinct()
    return years.withColumn("easter", when.easter(F.col("year")))


@query()
def holidays(spark, d):
    """Orders of each country's public holidays."""
    days = F.broadcast(H.holidays(spark, 1990, 2000))  # some 500 rows
    return t(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).join(days, "date").groupBy("country", "date").agg(F.count("*").alias("orders"))


@query("""
WITH filed(k, day, a, b) AS (SELECT 0, d, 720, 1140 FROM range(1, 6) r(d) UNION ALL VALUES (1, 4, 1200, 1680) UNION ALL SELECT 2, d, 0, 1440 FROM range(7) r(d) UNION ALL VALUES (4, 0, 540, 1020), (4, 2, 540, 1020), (4, 4, 540, 1020)),
v AS (SELECT s_suppkey, s_suppkey % 6 AS k, s_suppkey % 7 AS day, s_suppkey * 37 % 1440 AS m FROM supplier),
s AS (SELECT *, k IN (0, 1, 2, 4) AS known, (SELECT max(b) - 1440 FROM filed f WHERE f.k = v.k AND f.day = (v.day + 6) % 7 AND b > 1440 AND v.m < b - 1440) AS over,
  (SELECT max(b) FROM filed f WHERE f.k = v.k AND f.day = v.day AND v.m >= a AND v.m < b) AS now, (SELECT min(a) FROM filed f WHERE f.k = v.k AND f.day = v.day AND a > v.m) AS later FROM v),
c AS (SELECT *, over IS NOT NULL OR now IS NOT NULL AS open, k = 2 AS all_day, coalesce(over, now % 1440) AS closes FROM s)
SELECT s_suppkey, CASE WHEN NOT known THEN '' WHEN NOT open THEN 'SHUT' WHEN all_day THEN '24H' ELSE printf('→%02d', closes // 60) END AS rail,
  CASE WHEN NOT known THEN 'Hours not filed' WHEN open AND all_day THEN 'Open 24 hours' WHEN open THEN printf('Open now · closes %02d:%02d', closes // 60, closes % 60)
    WHEN later IS NOT NULL THEN printf('Opens %02d:%02d', later // 60, later % 60) ELSE 'Closed for the day' END AS label
FROM c
""")
def hours_state(spark, d):
    filed = F.element_at(F.array(*(F.lit(x) for x in ("Tu-Sa 12:00-19:00; Su,Mo off", "Fr 20:00-04:00", "24/7", "PH off", "Mo,We,Fr 09:00-17:00", "Su-PH 10:00-12:00"))), (F.col("s_suppkey") % 6 + 1).cast("int"))
    rows = t(spark, d, "supplier").select("s_suppkey", H.parse_hours(filed).alias("h")).withColumn("s", H.state(F.col("h"), (F.col("s_suppkey") % 7).cast("int"), (F.col("s_suppkey") * 37 % 1440).cast("int")))
    return rows.select("s_suppkey", H.rail(F.col("s")).alias("rail"), H.label(F.col("s")).alias("label"))


@query()
def hash53(spark, d):
    return t(spark, d, "pages").select("page_id", text.cyrb53(F.col("url")).alias("cyrb53"), text.fnv53(F.col("url")).alias("fnv53"))


# --- streams ---------------------------------------------------------------------------------------------------------


def _event_stream(spark, d, per_trigger=None):
    """The table as a stream, be it one file or a folder of part files: a plain path must be a folder, a pattern needn't."""
    schema = t(spark, d, "events").schema
    return queue.read_files(spark, f"{d}/events[.]parquet", schema, per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_watermark(spark, d):
    out = shared(spark)
    queue.run_once(queue.deduplicated(_event_stream(spark, d), ["event_id"], "ts"), f"{out}/rows", f"{out}/mark")
    return spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    out = shared(spark)
    counts = queue.windowed_counts(_event_stream(spark, d), "ts", ["event_type"], "1 hour")
    last = queue.run_complete(counts, f"{out}/state", f"{out}/mark")
    return last.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1")
def stream_heartbeats(spark, d):
    out = shared(spark)
    last = queue.run_complete(queue.heartbeats(_event_stream(spark, d), "user_id", "ts"), f"{out}/state", f"{out}/mark")
    return last.select("user_id", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))
