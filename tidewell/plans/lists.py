"""The operators on lists and lookups bound to the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import when
from ..operators import listing
from .bindings import query, t


@query("SELECT event_id, printf('%02d:%02d', m // 60, m % 60) AS label FROM (SELECT event_id, (CAST(date_part('hour', ts) * 60 + date_part('minute', ts) AS INTEGER) + 15) // 30 * 30 % 1440 AS m FROM events)")
def half_hours(spark, d):
    ts = F.col("ts")
    return t(spark, d, "events").select("event_id", listing.half_hour(F.hour(ts) * 60 + F.minute(ts)).alias("label"))


@query("SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%a') AS today FROM events")
def weekday_names(spark, d):
    return t(spark, d, "events").select("event_id", F.date_format(when.local_date(F.col("ts").cast("timestamp")), "EEE").alias("today"))


@query("SELECT s_suppkey, n_name || '|' || lower(trim(s_name)) AS key, n_name = 'FRANCE' AS followed FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def follow_keys(spark, d):
    rows = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = listing.follow_key(F.col("n_name"), F.col("s_name"))
    return rows.select("s_suppkey", key.alias("key"), listing.follows_in(key, F.lit("FRANCE")).alias("followed"))


@query("SELECT p_partkey, list_has_any(string_split(p_type, ' '), ['STEEL', 'BRASS', 'SMALL']) AS allowed FROM part")
def type_gate(spark, d):
    return t(spark, d, "part").select("p_partkey", listing.of_type(F.split("p_type", " "), ["STEEL", "BRASS", "SMALL"]).alias("allowed"))


@query("SELECT r_regionkey, r_name, coalesce((SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 2 = 0), '') AS nations FROM region")
def enriched_notes(spark, d):
    notes = t(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    return listing.enriched(t(spark, d, "region"), notes, "r_regionkey", "n_name", "nations")


@query("SELECT o_custkey AS c_custkey, count(*) AS n, any_value(c_name) AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) c ON c_custkey = o_custkey GROUP BY 1")
def titles_of_ids(spark, d):
    counted = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return listing.looked_up(counted, t(spark, d, "customer").where("c_custkey % 3 > 0"), "c_custkey", ["c_name"])


@query("SELECT k.p_brand, c.pic, c.pic IS NOT NULL AS hit FROM (SELECT DISTINCT p_brand FROM part) k LEFT JOIN (SELECT p_brand, min(p_name) AS pic FROM part WHERE p_size = 1 GROUP BY 1) c ON c.p_brand = k.p_brand")
def image_cache(spark, d):
    parts = t(spark, d, "part")
    cache = parts.where("p_size = 1").groupBy("p_brand").agg(F.min("p_name").alias("pic"))
    return listing.cached(parts, cache, "p_brand", "pic")


@query("SELECT coalesce(CAST(to_json(list(struct_pack(event_type := event_type, n := n) ORDER BY event_type)) AS VARCHAR), '[]') AS report FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def json_report(spark, d):
    return listing.report(t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), ["event_type"])


@query("""
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS seen, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM n)
SELECT user_id, CAST(any_value(seen) AS BIGINT) AS seen, CASE WHEN any_value(seen) >= 60 THEN string_agg(event_type, ',' ORDER BY rn) END AS kinds,
  CASE WHEN any_value(seen) >= 60 THEN string_agg(event_type, ',' ORDER BY rn) FILTER (WHERE rn <= 2) END AS lead
FROM r WHERE rn <= 4 GROUP BY user_id
""")
def top_kinds(spark, d):
    out = listing.top_kinds(t(spark, d, "events"), "user_id", "event_type", least=60)
    return out.select("user_id", "seen", F.array_join("kinds", ",").alias("kinds"), F.array_join("lead", ",").alias("lead"))


@query("SELECT CASE WHEN grouping(c_mktsegment) = 1 THEN 'all' ELSE c_mktsegment END AS c_mktsegment, CAST(sum(rich) AS BIGINT) AS rich, CAST(sum(poor) AS BIGINT) AS poor FROM (SELECT c_mktsegment, CAST(c_acctbal > 0 AS INT) AS rich, CAST(c_acctbal <= 0 AS INT) AS poor FROM customer) GROUP BY ROLLUP (c_mktsegment)")
def segment_totals(spark, d):
    rows = t(spark, d, "customer").select("c_mktsegment", (F.col("c_acctbal") > 0).cast("int").alias("rich"), (F.col("c_acctbal") <= 0).cast("int").alias("poor"))
    return listing.totals(rows, "c_mktsegment", ["rich", "poor"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def list_members(spark, d):
    there = t(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return listing.members(t(spark, d, "orders").select("o_orderkey", "o_custkey"), there, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE event_type <> 'click'), '') AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def purged_lists(spark, d):
    lists = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))
    return listing.purged(lists, "kinds", F.lit("click")).select("user_id", F.array_join("kinds", ",").alias("kinds"))


@query("""
SELECT s_suppkey, concat_ws(chr(10), CASE WHEN s_suppkey % 3 > 0 THEN 'Venue: ' || s_name END, 'Place: ' || CAST(s_nationkey AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN left(repeat(s_name, 9), 60) END) AS prose FROM supplier
""")
def labelled_prose(spark, d):
    s = t(spark, d, "supplier")
    venue, blurb = F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).otherwise(" "), F.when(F.col("s_suppkey") % 2 == 0, F.repeat(F.col("s_name"), 9))
    return s.select("s_suppkey", listing.prose([("Venue", venue), ("Place", F.col("s_nationkey"))], blurb, 60).alias("prose"))


@query("SELECT c_custkey // 50 AS page, c_custkey AS id, c_name AS title FROM customer")
def nested_listing(spark, d):
    """Pages of 50 made of the customers; the listing says how many there are."""
    c = t(spark, d, "customer").select(F.expr("c_custkey div 50").alias("page"), F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")).alias("r"), "c_custkey")
    body = F.to_json(F.struct(F.struct(F.struct(F.first("total").alias("total"), F.collect_list("r").alias("rows")).alias("listing")).alias("data")))
    pages = c.crossJoin(F.broadcast(c.agg(F.count("*").alias("total")))).groupBy("page").agg(body.alias("body"))
    return listing.listing_rows(pages, "page", "body", "struct<id long, title string>", most=None)
