"""Composite queries over the catalogue's own tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import web, when
from ..functions.geo import haversine, in_box, within
from ..operators import facets, lifecycle, match, rank, search, upsert
from ..schemas import PAYLOAD


def public(picks: DataFrame) -> DataFrame:
    """Live picks for show: not from discovery, and food places only with a day."""
    hidden = F.col("kind").isin(X.FOOD_KINDS) & (F.coalesce(F.col("day"), F.lit("")) == "")
    return picks.where(F.col("archived_at").isNull() & (F.coalesce(F.col("handle"), F.lit("")) != "@discovery") & ~F.coalesce(hidden, F.lit(False)))


def assembled(picks: DataFrame, venues: DataFrame, city: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(picks, venues) of a city as the catalogue shows them: positions filled in from venues of the same name, closed
    venues flagged, dates resolved, tonight and this week stamped."""
    today = when.local_date(now)
    shown = public(picks.where(F.col("city") == city)).withColumn("key", match.name_key(F.col("venue")))
    local = venues.where(F.col("city") == city).withColumn("key", match.name_key(F.col("name")))
    placed = match.fallback(shown, local.select("city", "key", "id", "lat", "lng").withColumnRenamed("id", "venue_key"), ["city", "key"], [F.asc("venue_key")], ["lat", "lng"])
    closed = local.where(F.col("status") == "closed").select("key")
    flagged = match.flagged(placed, closed, "key", "is_closed").drop("key")
    dated = flagged.withColumn("date", when.resolve_date(F.col("starts_at"), F.col("day"), today)).withColumn("minutes", when.stated_minutes(F.col("starts_at"), F.col("time")))
    for flag in ("tonight", "this_week"):
        dated = dated if flag in dated.columns else dated.withColumn(flag, F.lit(False))
    dated = when.stamped(dated, F.col("date"), today)
    initials = F.coalesce(X.or_null(F.col("thumb_initials")), X.initials(F.col("venue")))
    return dated.withColumn("thumb_initials", initials), local.where(F.col("kind").isin(X.VENUE_KINDS)).drop("key")


def filters(window: str, today: Column, now_minutes: Column, kinds: list[str] | None = None, free: bool = False, doors: str = "any", within_m: int | None = None, box: tuple | None = None, term: str = "") -> dict[str, Column]:
    """The named predicates of the main list, over assembled picks with `metres`."""
    out = {"when": when.matches_window(window, F.col("date"), today, F.col("tonight"), F.col("this_week")), "doors": when.doors_ok(F.col("minutes"), now_minutes, doors)}
    out["kind"] = F.col("kind").isin(kinds) if kinds else F.lit(True)
    out["free"] = web.free_ish(F.col("is_free"), F.col("price_min")) if free else F.lit(True)
    out["within"] = within(F.col("metres"), F.lit(within_m)) if within_m else F.lit(True)
    out["box"] = in_box(F.col("lat"), F.col("lng"), *box) if box else F.lit(True)
    out["text"] = facets.contains_text(term, *(F.col(c) for c in ("title", "venue", "neighborhood", "kind"))) if term else F.lit(True)
    return out


def tonight(picks: DataFrame, chain: dict[str, Column], at: tuple[float, float] | None = None, nearest: bool = False) -> DataFrame:
    """The main list: filtered, then soonest (or nearest) first. Without a position no distance is known."""
    metres = haversine(F.lit(at[0]), F.lit(at[1]), F.col("lat"), F.col("lng")) if at else F.lit(None).cast("double")
    order = [F.asc_nulls_last("metres"), F.asc("id")] if nearest else rank.soonest_then_nearest("minutes", "metres", "id")
    return picks.withColumn("metres", metres).where(facets.all_of(chain)).orderBy(*order)


def hybrid(picks: DataFrame, embeddings: DataFrame, query: str, vector: Column, city: str, limit: int = 20, lane: int = 50, pending: bool = False) -> DataFrame:
    """Text lane and vector lane, each its first 50, fused by reciprocal rank."""
    live = picks.where((F.col("city") == city) & F.col("archived_at").isNull() & (F.lit(pending) | ~F.coalesce(F.col("pending_review"), F.lit(False))))
    fields = [(F.array_join(F.col(c), " ") if c == "mood_tags" else F.col(c), w) for c, w in search.WEIGHTS.items()]
    words = search.text_rank(live, "id", fields, query, lane)
    near = search.nearest_vectors(embeddings.withColumnRenamed("pick_id", "id").join(live.select("id"), "id"), "id", "embedding", vector, lane)
    return search.fuse(words, near, "id", limit)


def dedup_active(picks: DataFrame, bookmarks: DataFrame, now: Column) -> DataFrame:
    """Archives all but the best of equal live picks: bookmarked, with an image, with context, newest, last id."""
    live = match.flagged(picks.where(F.col("archived_at").isNull()), bookmarks.select(F.col("pick_id").alias("id")), "id", "saved")
    by = [F.lower("city"), F.lower(F.coalesce("venue", F.lit(""))), F.lower("title"), F.coalesce("day", F.lit("")), F.coalesce("time", F.lit(""))]
    context = F.col("context_md").isNotNull() if "context_md" in picks.columns else F.lit(False)
    order = [F.desc("saved"), F.desc(F.col("image_url").isNotNull()), F.desc(context), F.desc_nulls_first("created_at"), F.desc("id")]
    best = rank.keep_best(live, by, order).select("id", F.lit(True).alias("__best"))
    marked = picks.join(best, "id", "left")
    return upsert.soft_archive(marked, F.col("archived_at").isNull() & F.col("__best").isNull(), now, "duplicate").drop("__best")


def reconcile(picks: DataFrame, staging: DataFrame, sources: DataFrame, now: Column, grace_days: int = 3, enforce: bool = False) -> tuple[DataFrame, DataFrame]:
    """(report by source, picks): live picks of sources that are reconciled, not seen within the grace."""
    live = picks.where(F.col("archived_at").isNull())
    on = sources.where(F.col("reconcile_absences")).select(F.col("id").alias("source_id"), F.col("channel").alias("source"))
    rows = live.join(staging.select(F.col("id").alias("source_message_id"), "source_id"), "source_message_id").join(on, "source_id")
    report = lifecycle.absent(rows, ["source"], "id", "last_seen_at", now, grace_days)
    gone = rows.where(F.col("last_seen_at") < F.timestamp_add("DAY", F.lit(-grace_days), now)).select("id")
    return report, lifecycle.reconcile(picks, gone, now, enforce)


def ingest_health(log: DataFrame, now: Column, exclude_self: bool = False, days: int = 14) -> DataFrame:
    """Ingest functions whose last three good runs brought nothing. Read as written, the check can flag itself."""
    runs = log.where(F.col("fn").like("ingest-%") & (F.col("status") == "ok"))
    if exclude_self:
        runs = runs.where(F.col("fn") != "ingest-health")
    skipped = F.coalesce(F.get_json_object("detail", "$.skipped").try_cast("int"), F.lit(0))
    idle = (F.coalesce(F.col("inserted"), F.lit(0)) == 0) & (skipped == 0)
    return lifecycle.zero_yield(runs, "fn", "finished_at", "id", idle, F.timestamp_add("DAY", F.lit(-days), now))


def staged_to_picks(staging: DataFrame, extracted: DataFrame, sources: DataFrame, now: Column, skip: list[str]) -> tuple[DataFrame, DataFrame]:
    """(messages with status and rejection, pick changes). `extracted` holds what a model read from each message:
    message id, and an array of candidates (title, venue, kind, neighborhood, day, time, quote, thumb_initials,
    mood_tags). Facts come from the payload; a fact that it lacks is null here and left alone by `merge_picks`."""
    rows = staging.join(sources.select(F.col("id").alias("source_id"), "curator_handle", "city"), "source_id", "left").join(extracted, "id", "left")
    pay = F.from_json("payload", PAYLOAD)
    hit = X.first_keyword(F.col("text"), skip) if skip else F.lit(None).cast("string")
    good = F.filter("candidates", lambda p: (F.coalesce(p["title"], F.lit("")) != "") & (F.coalesce(p["venue"], F.lit("")) != "") & (F.coalesce(p["kind"], F.lit("")) != "") & (F.coalesce(p["neighborhood"], F.lit("")) != ""))
    rows = rows.withColumns({"pay": pay, "skip": hit, "good": good})
    reason = F.coalesce(F.concat(F.lit("skip_keyword: "), F.col("skip")), F.when(F.coalesce(F.size("good"), F.lit(0)) <= 0, F.when(F.coalesce(F.size("candidates"), F.lit(0)) > 0, F.lit("all picks missing required fields")).otherwise(F.lit("no picks extracted"))))
    judged = rows.withColumn("rejection", reason).withColumn("status", F.when(F.col("rejection").isNotNull(), "rejected").otherwise("processed"))
    p = F.col("p")
    base = F.concat_ws("-", "channel", F.col("message_id").cast("string"))
    pid = F.lower(F.when(F.size("good") == 1, base).otherwise(F.concat_ws("-", base, X.slug(p["title"]))))
    named = F.filter(F.col("pay.entities"), lambda e: X.or_null(e["name"]).isNotNull())
    entities = F.slice(F.transform(named, lambda e: F.struct(F.trim(e["name"]).alias("name"), F.coalesce(e["role"], F.lit("artist")).alias("role"))), 1, 12)
    day = X.or_null(p["day"])
    picks = judged.where("status = 'processed'").withColumn("p", F.explode("good")).select(
        pid.alias("id"), F.coalesce("city", F.lit("tallinn")).alias("city"), p["title"].alias("title"), p["venue"].alias("venue"), p["neighborhood"].alias("neighborhood"), p["kind"].alias("kind"),
        day.alias("day"), X.or_null(p["time"]).alias("time"), X.says_something(p["quote"], p["title"]).alias("quote"), F.coalesce("curator_handle", "channel").alias("handle"),
        F.upper(F.substring(F.coalesce(X.or_null(p["thumb_initials"]), F.substring(p["venue"], 1, 2), F.lit("??")), 1, 2)).alias("thumb_initials"),
        F.coalesce(day == "Tonight", F.lit(False)).alias("tonight"), day.isNotNull().alias("this_week"), X.valid_moods(F.transform(p["mood_tags"], lambda t: F.lower(F.trim(t)))).alias("mood_tags"),
        F.lit(True).alias("auto_generated"), F.col("id").alias("source_message_id"), F.when(web.is_permalink(F.col("permalink")), F.col("permalink")).alias("source_url"),
        X.or_null(F.col("pay.description")).alias("description"), F.try_to_timestamp(X.or_null(F.col("pay.starts_at"))).alias("starts_at"), F.try_to_timestamp(X.or_null(F.col("pay.ends_at"))).alias("ends_at"),
        X.or_null(F.col("pay.ticket_url")).alias("ticket_url"), F.col("pay.is_free").alias("is_free"), F.col("pay.price_min").cast("decimal(10,2)").alias("price_min"), F.col("pay.price_max").cast("decimal(10,2)").alias("price_max"),
        X.or_null(F.col("pay.currency")).alias("currency"), F.when(F.size(entities) > 0, entities).alias("entities"), when.valid_until(day, now).alias("valid_until"), F.lit(None).cast("timestamp").alias("archived_at"),
    )
    return judged.select("id", "status", "rejection", F.when(F.col("status") == "processed", F.lower(base)).alias("pick_id")), picks


FACTS = ["description", "starts_at", "ends_at", "ticket_url", "is_free", "price_min", "price_max", "currency", "entities"]


def merge_picks(picks: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert: what a message states overwrites, facts that it lacks stay. A pick that comes again is live again."""
    return upsert.upsert(picks, changes, ["id"], {c: F.col(c).isNotNull() for c in FACTS})


def saved_buckets(saved: DataFrame, picks: DataFrame, venues: DataFrame, past: DataFrame, today: Column) -> DataFrame:
    """Saved ids as dated (with a date from today on), anytime, or gone (archived, over, or only in the past list)."""
    p = picks.select(F.col("id").alias("pick_id"), "title", "archived_at", when.resolve_date(F.col("starts_at"), F.col("day"), today).alias("date"), F.lit(True).alias("is_pick"))
    v = venues.select(F.col("id").alias("pick_id"), F.col("name").alias("venue_name"), F.lit(True).alias("is_venue"))
    o = past.select(F.col("id").alias("pick_id"), F.col("title").alias("past_title"))
    rows = saved.join(p, "pick_id", "left").join(v, "pick_id", "left").join(o, "pick_id", "left")
    live = F.coalesce(F.col("is_pick"), F.lit(False)) & F.col("archived_at").isNull()
    bucket = F.when(live & (F.col("date") >= today), "dated").when((live & F.col("date").isNull()) | F.coalesce(F.col("is_venue"), F.lit(False)), "anytime").otherwise("gone")
    return rows.select("pick_id", F.coalesce("title", "venue_name", "past_title").alias("title"), "date", bucket.alias("bucket"))


def digest(recipients: DataFrame, bookmarks: DataFrame, changes: DataFrame, picks: DataFrame, since: Column) -> DataFrame:
    """Per recipient the saved live picks that changed since a time, with their latest change."""
    latest = rank.keep_best(changes.where(F.col("changed_at") >= since), ["pick_id"], [F.desc_nulls_last("changed_at"), F.desc("id")]).drop("id")
    live = picks.where(F.col("archived_at").isNull()).select(F.col("id").alias("pick_id"), "title", "venue")
    return recipients.join(bookmarks.select("user_id", "pick_id"), "user_id").join(latest, "pick_id").join(live, "pick_id")


def calendar(picks: DataFrame, today: Column, site: str) -> DataFrame:
    """One calendar text of all dated live picks that are not under review, by id: two hours each, from 19:00 unless stated."""
    rows = public(picks).where((F.coalesce(F.col("day"), F.lit("")) != "") & ~F.coalesce(F.col("pending_review"), F.lit(False)))
    date = when.resolve_date(F.lit(None).cast("timestamp"), F.col("day"), today)
    start = F.timestamp_add("MINUTE", F.coalesce(when.clock_minutes(F.col("time")), F.lit(19 * 60)), F.coalesce(date, today).cast("timestamp"))
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")
    link = F.concat(F.lit(site), F.url_encode("id"))
    place = X.join_parts(", ", F.col("venue"), F.col("neighborhood"))
    about = X.join_parts("\n", F.col("quote"), F.concat(F.lit("via "), F.nullif(F.col("handle"), F.lit(""))), link)
    line = lambda name, v: F.when(v != "", F.concat(F.lit(name), X.escape_ics(v)))
    event = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), X.escape_ics(F.col("id"))), F.concat(F.lit("DTSTART:"), stamp(start)), F.concat(F.lit("DTEND:"), stamp(F.timestamp_add("HOUR", F.lit(2), start))), line("SUMMARY:", F.col("title")), line("LOCATION:", place), line("DESCRIPTION:", about), line("URL:", link), F.lit("END:VEVENT"))
    return rows.select("id", event.alias("event"))


def calendar_feed(events: DataFrame, name: str) -> DataFrame:
    """The feed itself, (text) in order: its head, a row an event by id, its tail. Spark sorts ranges, so it is written as
    part files that follow each other; no row holds more than one event."""
    spark = events.sparkSession
    head = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.lit("PRODID:-//tidewell//calendar//EN"), F.lit("CALSCALE:GREGORIAN"), F.concat(F.lit("X-WR-CALNAME:"), X.escape_ics(F.lit(name))))
    ends = spark.range(2).select(F.col("id").alias("part"), F.lit("").alias("id"), F.when(F.col("id") == 0, head).otherwise(F.lit("END:VCALENDAR")).alias("text"))
    ends = ends.withColumn("part", F.col("part") * 2)
    return events.select(F.lit(1).cast("long").alias("part"), F.col("id").cast("string"), F.col("event").alias("text")).unionByName(ends).orderBy("part", "id").select("text")


def geocode_queue(picks: DataFrame, now: Column, budget: int) -> DataFrame:
    """Places to look up, cities in turn: live picks without a position grouped by venue, real venues only, not tried lately."""
    want = picks.where(F.col("archived_at").isNull() & F.col("lat").isNull() & ~X.is_generic_venue(F.col("venue")))
    if "geocode_failed_at" in picks.columns:
        want = want.where(when.cooled_down(F.col("geocode_failed_at"), now))
    groups = want.groupBy("city", "venue", "neighborhood").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rank.round_robin(groups, "city", [F.asc_nulls_last("venue"), F.asc_nulls_last("neighborhood")], budget)


def discover(places: DataFrame, venues: DataFrame, prompt: str, limit: int = 20) -> DataFrame:
    """Places that a prompt asks for, flagged if they are known venues already."""
    kinds = [k for p, k in X.PROMPT_KINDS if re.search(p, prompt, re.I)]
    hits = search.fuzzy_places(places, "id", "name", "category", "kind", "confidence", prompt, kinds, limit)
    known = venues.select("city", match.name_key(F.col("name")).alias("key")).distinct().withColumn("known", F.lit(True))
    return hits.withColumn("key", match.name_key(F.col("name"))).join(known, ["city", "key"], "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("key")


def closures(venues: DataFrame, elements: DataFrame) -> DataFrame:
    """Venues that map elements call closed: by map id first, else by name; one reason each."""
    by_id = rank.keep_best(elements.select(F.col("id").alias("osm_id"), F.concat(F.lit("tags: "), F.col("reason")).alias("why")), ["osm_id"], [F.asc("why")])
    by_name = rank.keep_best(elements.where(F.col("name").isNotNull()).select(X.normalised_name(F.col("name")).alias("norm"), F.concat(F.lit("name: "), F.col("name")).alias("why")), ["norm"], [F.asc("why")])
    rows = venues.withColumn("norm", X.normalised_name(F.col("name")))
    return match.priority_match(rows, [("id", by_id, ["osm_id"]), ("name", by_name, ["norm"])], "why").where(F.col("why").isNotNull()).drop("norm")


def resolved_links(picks: DataFrame, hub: DataFrame) -> DataFrame:
    """Links by platform for each pick's first four entities: the first answer in order of entity, then link.
    hub: (name, score, found_name, links array<string>)."""
    from ..operators.rank import keep_best

    who = picks.select("id", F.posexplode(F.slice("entities", 1, 4)).alias("e_pos", "e")).withColumn("norm", X.normalised_name(F.col("e.name")))
    sure = hub.withColumn("norm", X.normalised_name(F.col("name"))).where((F.col("score") >= 90) & (F.col("norm") == X.normalised_name(F.col("found_name"))))
    urls = who.join(sure.select("norm", F.posexplode("links").alias("l_pos", "url")), "norm").withColumn("platform", web.platform(F.col("url"))).where(F.col("platform").isNotNull())
    first = keep_best(urls, ["id", "platform"], [F.asc("e_pos"), F.asc("l_pos"), F.asc("url")])
    return first.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "url")))).alias("links"))


def rail_text(minutes: Column, started: Column, tonight_: Column, day: Column, hours_rail: Column) -> Column:
    """The short label beside a row, never blank: NOW or a clock, TON, a weekday, the hours' arrow, OPEN."""
    from ..functions.hours import clock

    return F.coalesce(
        F.when(minutes.isNotNull(), F.when(F.coalesce(started, F.lit(False)), F.lit("NOW")).otherwise(clock(minutes))),
        F.when(F.coalesce(tonight_, F.lit(False)), F.lit("TON")),
        F.upper(F.substring(X.or_null(day), 1, 3)),
        X.or_null(hours_rail),
        F.lit("OPEN"),
    )


def source_page(picks: DataFrame, venue: str | None = None, handle: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(a venue's or handle's live picks, newest first; one row: how many, and when one was last seen)."""
    mine = public(picks).where((F.lower("venue") == venue.lower()) if venue else (F.lower("handle") == (handle or "").lower()))
    return mine.orderBy(F.desc_nulls_last("created_at"), "id"), mine.agg(F.count("*").alias("n"), F.max(F.coalesce("last_seen_at", "created_at")).alias("freshest"))


def saved_rail(minutes: Column, tonight_: Column, day: Column) -> Column:
    """The label beside a saved row: a stated clock as it is, even once begun; TON, a weekday, OPEN."""
    return rail_text(minutes, F.lit(False), tonight_, day, F.lit(None).cast("string"))


def place_rail(is_place: Column, hours_rail: Column, tonight_: Column, day: Column) -> Column:
    """The label beside a row of the map: a place, or whoever files hours, says them or OPEN; a pick its day."""
    filed = F.coalesce(is_place, F.lit(False)) | hours_rail.isNotNull()
    none = F.lit(None).cast("int")
    return F.when(filed, F.coalesce(X.or_null(hours_rail), F.lit("OPEN"))).otherwise(saved_rail(none, tonight_, day))


def badge(is_place: Column, open_now: Column, free: Column, minutes: Column, now_minutes: Column, tonight_: Column) -> Column:
    """struct(text, now), or null where nothing is known: places say Open only; picks Free, Now once begun today, Doors and
    a clock, Tonight."""
    from ..functions.hours import clock

    yes = lambda c: F.coalesce(c, F.lit(False))
    sign = lambda text, now: F.struct(text.alias("text"), F.lit(now).alias("now"))
    pick = F.when(yes(free), sign(F.lit("Free"), False)).when(yes(tonight_) & (minutes <= now_minutes), sign(F.lit("Now"), True)).when(minutes.isNotNull(), sign(F.concat(F.lit("Doors "), clock(minutes)), False)).when(yes(tonight_), sign(F.lit("Tonight"), False))
    return F.when(yes(is_place), F.when(yes(open_now), sign(F.lit("Open"), True))).otherwise(pick)


def venue_groups(picks: DataFrame) -> DataFrame:
    """Picks at real venues by venue and neighbourhood, whatever the case: spellings and position (null unless whole) of the
    first pick by id, and how many. Ids stay in their rows: `ids` is their number, `first_id` the first of them."""
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = picks.where(~X.is_generic_venue(F.col("venue"))).select("id", trimmed("venue").alias("venue"), trimmed("neighborhood").alias("neighborhood"), F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct("lat", "lng")).alias("at"))
    groups = rows.groupBy(F.lower("venue").alias("v"), F.lower("neighborhood").alias("n")).agg(F.min_by(F.struct("venue", "neighborhood", "at"), "id").alias("first"), F.min("id").alias("first_id"), F.count("*").alias("ids"))
    return groups.select("first.venue", "first.neighborhood", "first.at.lat", "first.at.lng", "first_id", "ids")


def finds_saved(picks: DataFrame, hits: DataFrame, venues: DataFrame, prompt: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(picks with a prompt's finds merged by id, one row of counts: places, inserted, rejected). hits: of the index of places
    (id, city, name, kind, locality, lat, lng). A name that a venue of the city has is spelled as there. Each find is a pick
    under review for thirty days, whatever stood under its id; hits without a name are rejected, and of several that make
    one id the first by place counts."""
    lower = lambda c: F.lower(F.trim(F.col(c)))
    spelled = venues.groupBy("city", lower("name").alias("__key")).agg(F.min("name").alias("__known"))
    named = hits.withColumn("__key", lower("name")).join(spelled, ["city", "__key"], "left").withColumn("name", F.coalesce("__known", X.or_null(F.col("name"))))
    made = F.when(F.col("name").isNotNull(), F.concat(F.lit("discovery-"), X.slug(F.col("name")), F.lit("-"), F.expr("right(id, 8)")))
    judged = named.withColumns({"__place": F.col("id"), "id": made})
    local = X.or_null(F.col("locality"))
    found = {
        "city": F.col("city"), "title": F.concat("name", F.lit(" — pending review")), "venue": F.col("name"), "kind": F.col("kind"), "handle": F.lit("@discovery"),
        "neighborhood": F.when(F.lower(local) != F.lower("city"), local).otherwise("other"), "quote": F.lit(f'Found in the index of places for "{prompt}"; nobody has vouched for it yet.'),
        "thumb_initials": X.initials(F.col("name")), "tonight": F.lit(False), "this_week": F.lit(False), "pending_review": F.lit(True), "archived_at": F.lit(None).cast("timestamp"),
        "valid_until": F.timestamp_add("DAY", F.lit(30), now), "lat": F.col("lat"), "lng": F.col("lng"), "coords_source": F.when(F.col("lat").isNotNull(), "venue_join"),
    }
    rows = rank.keep_best(judged.where("id is not null"), ["id"], [F.asc("__place")]).select("id", *(c.alias(n) for n, c in found.items() if n in picks.columns))
    counts = judged.agg(F.count("*").alias("places"), F.count_if(F.col("id").isNotNull()).alias("inserted"), F.count_if(F.col("id").isNull()).alias("rejected"))
    return upsert.upsert(picks, rows, ["id"]), counts
