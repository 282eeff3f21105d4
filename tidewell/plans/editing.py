"""What editors, readers and helpers change by hand: reviews, forms, translations, dead pictures, opt-outs, and the
texts and counts that they are shown. Lookups that need a network come in as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hours as H
from ..functions import text as X
from ..functions.geo import METRES_A_MINUTE, distance_label, haversine, walk_minutes, within
from ..functions.when import DAYS
from ..operators import rank, upsert

# The shape of a token, the note on titles under review, and the longest translated texts.
TOKEN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PENDING_NOTE = r"(?i)\s*[—-]\s*pending review\s*$"
LONGEST_TITLE, LONGEST_TEXT = 90, 4000
# How far the shelf of open places reaches, in minutes of walking.
SHELF_MINUTES = 20


def opt_out(opt_ins: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(opt-ins without those whose id is a well-formed token, outcome by token: invalid, removed or already)."""
    asked = tokens.select(F.lower("token").alias("id")).distinct()
    good = asked.where(F.col("id").rlike(TOKEN))
    known = opt_ins.select(F.lower("id").alias("id"), F.lit(True).alias("__there")).distinct()
    outcome = F.when(~F.coalesce(F.col("id").rlike(TOKEN), F.lit(False)), "invalid").when(F.col("__there"), "removed").otherwise("already")
    told = asked.join(known, "id", "left").select(F.col("id").alias("token"), outcome.alias("outcome"))
    left = opt_ins.withColumn("__id", F.lower("id")).join(good.withColumnRenamed("id", "__id"), "__id", "left_anti").drop("__id")
    return left, told


def opt_in(opt_ins: DataFrame, new: DataFrame) -> DataFrame:
    return opt_ins.unionByName(new, allowMissingColumns=True)


def heal(rows: DataFrame, url: str, dead: DataFrame) -> DataFrame:
    """Dead addresses become null. `dead` holds each distinct address that a check found gone."""
    gone = dead.select(F.col(url)).distinct().withColumn("__dead", F.lit(True))
    return rows.join(gone, url, "left").withColumn(url, F.when(F.col("__dead"), None).otherwise(F.col(url))).select(*rows.columns)


def to_check(rows: DataFrame, url: str, budget: int) -> DataFrame:
    """Distinct addresses to check, first ones by text, with how many rows share each."""
    return rank.top_k(rows.where(F.col(url).isNotNull()).groupBy(url).agg(F.count("*").alias("n")), [F.asc(url)], budget)


def translated(picks: DataFrame, answers: DataFrame) -> DataFrame:
    """picks with translations (id, lang, title, quote, description), each field under a guard of its own: titles that
    differ and hold no Cyrillic, quotes that replace Cyrillic ones, descriptions where there was another one. The first
    title is kept as title_original. Answers in English change nothing."""
    cols = ("title", "quote", "description")
    said = answers.where(~F.coalesce(F.col("lang") == "en", F.lit(True))).select("id", *(X.or_null(F.col(c)).alias(f"__{c}") for c in cols))
    title, quote, text = (F.col(f"__{c}") for c in cols)
    no = lambda c: F.coalesce(c, F.lit(False))
    new_title = no(~X.is_cyrillic(title) & (F.lower(title) != F.lower(F.trim(F.coalesce("title", F.lit(""))))))
    new_quote = no(X.is_cyrillic(F.col("quote")) & ~X.is_cyrillic(quote))
    new_text = no(X.or_null(F.col("description")).isNotNull() & (text != F.trim("description")))
    changed = {
        "title": F.when(new_title, F.substring(title, 1, LONGEST_TITLE)).otherwise(F.col("title")),
        "title_original": F.when(new_title, F.coalesce("title_original", "title")).otherwise(F.col("title_original")),
        "quote": F.when(new_quote, quote).otherwise(F.col("quote")),
        "description": F.when(new_text, F.substring(text, 1, LONGEST_TEXT)).otherwise(F.col("description")),
    }
    return picks.join(said, "id", "left").select(*(changed[c].alias(c) if c in changed else F.col(c) for c in picks.columns))


def approved(picks: DataFrame, ids: DataFrame) -> DataFrame:
    """Reviewed picks are shown, without the note in their titles; a title of nothing else stays."""
    plain = F.nullif(F.regexp_replace("title", PENDING_NOTE, ""), F.lit(""))
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    marked = picks.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    out = upsert.update_where(marked, hit, {"pending_review": F.lit(False), "title": F.coalesce(plain, F.col("title"))})
    return out.select(*picks.columns)


def rejected(picks: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    marked = picks.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return upsert.update_where(marked, hit, {"archived_at": now}).select(*picks.columns)


def form_saved(picks: DataFrame, forms: DataFrame) -> DataFrame:
    """An editor's forms, all text: blank fields are null. With both coordinates blank the place is forgotten (address
    and source, too); with both given it is set, and a pin that was dragged says so; with one it stays."""
    texts = [c for c in ("title", "venue", "kind", "neighborhood", "handle", "day", "quote") if c in forms.columns]
    blank = lambda c: X.or_null(F.col(c))
    lat, lng = (blank(c).try_cast("double") for c in ("lat", "lng"))
    given, none = lat.isNotNull() & lng.isNotNull(), blank("lat").isNull() & blank("lng").isNull()
    made = forms.select("id", *(blank(c).alias(c) for c in texts), lat.alias("lat"), lng.alias("lng"), F.lit(None).cast("string").alias("address"), F.when(given & F.col("dragged"), "manual").alias("coords_source"), F.coalesce("locked", F.lit(False)).alias("coords_locked"), given.alias("__given"), none.alias("__none"), F.coalesce("dragged", F.lit(False)).alias("__drag"))
    there = {"lat": F.col("__given") | F.col("__none"), "lng": F.col("__given") | F.col("__none"), "address": F.col("__none"), "coords_source": F.col("__none") | (F.col("__given") & F.col("__drag"))}
    return upsert.upsert(picks, made, ["id"], there, only=[*texts, "lat", "lng", "address", "coords_source", "coords_locked"])


def city_stats(picks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """By city, over live picks: picks, unpinned, pending_review, no_embedding."""
    live = picks.where(F.col("archived_at").isNull())
    with_vector = embeddings.select(F.col("pick_id").alias("id")).distinct().withColumn("__vector", F.lit(True))
    return live.join(with_vector, "id", "left").groupBy("city").agg(
        F.count("*").alias("picks"), F.count_if(F.col("lat").isNull() | F.col("lng").isNull()).alias("unpinned"), F.count_if(F.col("handle") == "@discovery").alias("pending_review"), F.count_if(F.col("__vector").isNull()).alias("no_embedding")
    )


def open_shelf(venues: DataFrame, day: Column, minutes: Column, at: tuple[float, float] | None = None) -> DataFrame:
    """Venues (with parsed `hours`) open at a minute of a weekday, nearest first; those with a known distance only within
    the shelf's walk. Unknown hours are never called open."""
    metres = haversine(F.lit(at[0]), F.lit(at[1]), F.col("lat"), F.col("lng")) if at else F.lit(None).cast("double")
    shown = venues.withColumns({"state": H.state(F.col("hours"), day, minutes), "metres": metres}).where("state.known and state.open")
    return shown.where(within(F.col("metres"), F.lit(SHELF_MINUTES * METRES_A_MINUTE))).orderBy(F.asc_nulls_last("metres"), "name", "id")


def meta_line(neighborhood: Column, kind: Column, day: Column, time: Column) -> Column:
    """'Kalamaja · gig · Fri 19:00': parts that are missing are left out."""
    when = F.when((F.coalesce(day, F.lit("")) != "") & (day != "Tonight"), F.trim(F.concat(day, F.lit(" "), F.coalesce(time, F.lit(""))))).otherwise(time)
    return X.join_parts(" · ", neighborhood, kind, when)


def digest_lines(picks: DataFrame, site: str) -> DataFrame:
    """Each pick as the lines of a plain-text digest: (city, id, tonight, sort_order, created_at, body)."""
    head = F.concat(F.when(F.coalesce(F.col("tonight"), F.lit(False)), F.lit("[TONIGHT] ")).otherwise(""), F.coalesce("title", F.lit("")))
    body = X.join_parts("\n", head, meta_line(F.col("neighborhood"), F.col("kind"), F.col("day"), F.col("time")), F.col("quote"), F.concat(F.lit("via "), F.nullif("handle", F.lit(""))), F.concat(F.lit(site), F.url_encode("id")))
    return picks.select("city", "id", "tonight", "sort_order", "created_at", body.alias("body"))


def digest_text(picks: DataFrame, site: str, most: int = 5) -> DataFrame:
    """By city the digest's text: the first picks, tonight's first, then by order and age."""
    lines = digest_lines(picks.where(F.col("archived_at").isNull()), site)
    order = [F.desc_nulls_last("tonight"), F.asc_nulls_last("sort_order"), F.asc_nulls_last("created_at"), F.asc("id")]
    first = rank.first_n(lines, ["city"], order, most, "turn")  # at most `most` rows a city are gathered
    return first.groupBy("city").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"]), "\n\n").alias("text"))


def digest_rows_html(picks: DataFrame, site: str) -> DataFrame:
    """Each pick as a row of a letter's table, all texts escaped: (city, id, tonight, sort_order, created_at, body)."""
    said = lambda c: X.escape_html(F.coalesce(c, F.lit("")))
    mark = F.when(F.coalesce(F.col("tonight"), F.lit(False)), F.lit('<b class="tonight">Tonight</b> ')).otherwise("")
    link = F.concat(F.lit(f'<a href="{site}'), F.url_encode("id"), F.lit('">'), said(F.col("title")), F.lit("</a>"))
    meta = said(meta_line(F.col("neighborhood"), F.col("kind"), F.col("day"), F.col("time")))
    lines = [F.concat(F.lit('<p class="title">'), mark, link, F.lit("</p>")), *(F.concat(F.lit(f'<p class="{name}">'), c, F.lit("</p>")) for name, c in (("meta", meta), ("quote", said(F.col("quote"))), ("by", F.concat(F.lit("via "), said(F.col("handle"))))))]
    return picks.select("city", "id", "tonight", "sort_order", "created_at", F.concat(F.lit("<tr><td>"), *lines, F.lit("</td></tr>")).alias("body"))


def digest_html(picks: DataFrame, site: str, intro: Column, most: int = 5) -> DataFrame:
    """By city the digest as a page: the same picks as `digest_text`, at most `most` a city, behind a heading and an intro."""
    lines = digest_rows_html(picks.where(F.col("archived_at").isNull()), site)
    order = [F.desc_nulls_last("tonight"), F.asc_nulls_last("sort_order"), F.asc_nulls_last("created_at"), F.asc("id")]
    first = rank.first_n(lines, ["city"], order, most, "turn")  # at most `most` rows a city are gathered
    rows = first.groupBy("city").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"]), "").alias("rows"))
    name = X.escape_html(F.concat(F.upper(F.substring("city", 1, 1)), F.expr("substring(city, 2)")))
    head = F.concat(F.lit('<!doctype html><html lang="en"><head><meta charset="utf-8"><title>'), name, F.lit("</title></head><body><h1>This week in "), name, F.lit("</h1><p>"), X.escape_html(intro), F.lit("</p><table>"))
    return rows.select("city", F.concat(head, F.col("rows"), F.lit("</table></body></html>")).alias("html"))


def pipeline_panel(queue: DataFrame, logs: DataFrame, most: int = 5) -> DataFrame:
    """What an operator looks at first, as rows (part, name, n, detail): how many messages wait in each status (unknown ones
    as such), then the last runs by id (a top-k), with the error or what came in and was rejected."""
    waiting = queue.groupBy(F.coalesce("status", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("queue").alias("part"), "name", "n", F.lit(None).cast("string").alias("detail"))
    last = rank.top_k(logs, [F.desc("id")], most)
    told = F.coalesce(X.or_null(F.col("error")), F.format_string("%d in, %d rejected", F.coalesce("inserted", F.lit(0)).cast("long"), F.coalesce("rejected", F.lit(0)).cast("long")))
    return waiting.unionByName(last.select(F.lit("run").alias("part"), F.concat_ws(" ", "fn", "status").alias("name"), F.col("id").cast("long").alias("n"), told.alias("detail")))


def changed_lines(changes: DataFrame) -> DataFrame:
    """Saved picks' latest changes (title, venue, old_day, new_day, old_time, new_time, gone) as lines."""
    said = lambda p: F.trim(F.concat_ws(" ", f"{p}_day", f"{p}_time"))
    moved = F.concat(F.col("title"), F.lit(" — now "), said("new"), F.lit(" (was "), said("old"), F.lit(")"))
    gone = F.concat(F.col("title"), F.lit(" — no longer listed ("), F.coalesce("venue", F.lit("")), F.lit(")"))
    return changes.withColumn("line", F.when(F.coalesce(F.col("gone"), F.lit(False)), gone).otherwise(moved))


def headline(n: Column, kinds: list[str], window: str = "", day: Column | None = None, today: Column | None = None) -> Column:
    """'3 gigs tonight', '1 thing on Friday': how many, of what, when. An exact day outranks the window."""
    one = n == 1
    noun = F.concat(F.lit(kinds[0]), F.when(one, "").otherwise("s")) if len(kinds) == 1 else F.lit(" and ".join(kinds)) if kinds else F.when(one, "thing").otherwise("things")
    then = F.lit(f" {window}" if window else "")
    if day is not None:
        then = F.when(day == today, " tonight").when(day == F.date_add(today, 1), " tomorrow").otherwise(F.concat(F.lit(" on "), F.date_format(day, "EEEE")))
    return F.concat(n.cast("string"), F.lit(" "), noun, then)


def subline(n: Column, within_m: int = 0, in_area: bool = False, nearest: bool = False) -> Column:
    """What bounds and orders the list, in capitals; empty for an empty list."""
    near = F.concat(F.lit("within "), distance_label(F.lit(within_m)), F.lit(" of you ("), walk_minutes(F.lit(within_m)).cast("string"), F.lit(" min)")) if within_m else F.lit(None).cast("string")
    area = F.lit("in this map area" if in_area else None).cast("string")
    return F.when(n > 0, F.upper(F.concat_ws(" · ", near, area, F.lit("nearest first" if nearest else "soonest first")))).otherwise("")


def week_board(picks: DataFrame, kind: str | None = None, day: str | None = None, until: tuple[str | None, str | None] = (None, None), sort: str = "day") -> DataFrame:
    """This week's live picks as the editor sees them, sorted by day (unknown days last), title, kind or date; `until`
    bounds valid_until, and rows without one are out then."""
    rows = picks.where(F.col("archived_at").isNull() & F.coalesce(F.col("this_week"), F.lit(False)))
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.where(F.col("day") == day) if day else rows
    stamp = F.date_format("valid_until", "yyyy-MM-dd")
    rows = rows.where(stamp >= until[0]) if until[0] else rows
    rows = rows.where(stamp <= until[1]) if until[1] else rows
    order = {"day": rank.by_fixed_order(F.col("day"), ["Tonight", *DAYS]), "title": F.asc_nulls_first("title"), "kind": F.asc_nulls_first("kind"), "date": F.asc_nulls_first("valid_until")}
    return rows.orderBy(order[sort], "id")
