"""URLs, hosts and prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts (and their subdomains) -> platform; the first that fits.
PLATFORMS = [
    (r"open\.spotify\.com", "spotify"),
    (r"spotify\.com", "spotify"),
    (r"soundcloud\.com", "soundcloud"),
    (r"bandcamp\.com", "bandcamp"),
    (r"mixcloud\.com", "mixcloud"),
    (r"discogs\.com", "discogs"),
    (r"(ra\.co|residentadvisor\.net)", "residentadvisor"),
    (r"(youtube\.com|youtu\.be)", "youtube"),
    (r"last\.fm", "lastfm"),
    (r"facebook\.com", "facebook"),
    (r"instagram\.com", "instagram"),
    (r"(twitter\.com|x\.com)", "twitter"),
    (r"bsky\.app", "bluesky"),
    (r"imdb\.com", "imdb"),
    (r"letterboxd\.com", "letterboxd"),
    (r"openlibrary\.org", "openlibrary"),
    (r"wikidata\.org", "wikidata"),
    (r"wikipedia\.org", "wikipedia"),
]
# Ticket sellers' hosts, and words for "free".
TICKET_HOSTS = r"(?i)fienta|piletilevi|bilesu|tiketti|ra\.co"
FREE_WORDS = r"(?i)bezmaksas|free|бесплатно"


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def platform(url: Column) -> Column:
    h = host(url)
    return F.coalesce(*(F.when(h.rlike(rf"(^|\.){p}$"), F.lit(name)) for p, name in PLATFORMS))


# What is said of a listing's origin, and how a number in a price is written.
OWN_DESK, TICKETING, VENUE_PAGE = "Filed by our own desk", "The ticketing listing", "The venue's own page"
PRICE_NUMBER = r"(\d+(?:[.,]\d{1,2})?)"


def provenance(link: Column) -> Column:
    h = F.split_part(F.regexp_replace(F.coalesce(link, F.lit("")), r"^https?://(www\.)?", ""), F.lit("/"), F.lit(1))
    return F.when(F.coalesce(link, F.lit("")) == "", OWN_DESK).when(h.rlike(TICKET_HOSTS), TICKETING).otherwise(VENUE_PAGE)


def safe_url(url: Column) -> Column:
    """The url if it is http, https or relative; else empty."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return F.when(u.rlike("(?i)^https?://") | (~u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~u.startswith("//")), u).otherwise(F.lit(""))


def is_permalink(url: Column) -> Column:
    return F.coalesce(url.rlike("(?i)^https?://") & ~url.rlike(r"(?i)//(www\.)?t\.me/|telegram"), F.lit(False))


def social_url(value: Column, base: str) -> Column:
    """A full address as it is; a handle behind the base; null for none."""
    v = F.nullif(F.trim(value), F.lit(""))
    return F.when(v.rlike("(?i)^https?://"), v).otherwise(F.concat(F.lit(base), F.regexp_replace(F.regexp_replace(v, "^@", ""), "^/", "")))


def sized_photo(url: Column, width: int) -> Column:
    return F.when(url.contains("googleusercontent.com"), F.regexp_replace(url, "(?i)=[-a-z0-9]+$", f"=w{width}")).otherwise(url)


def proxied(url: Column, pattern: str, base: str) -> Column:
    """Addresses that match go through a proxy."""
    return F.when(url.rlike(pattern), F.concat(F.lit(base), F.url_encode(url))).otherwise(url)


def price_label(is_free: Column, low: Column, high: Column, currency: Column) -> Column:
    sign = F.when(currency == "EUR", F.lit("€")).otherwise(F.coalesce(F.concat(F.nullif(currency, F.lit("")), F.lit(" ")), F.lit("")))
    shown = lambda v: F.when(v.cast("double") % 1 == 0, v.cast("long").cast("string")).otherwise(F.format_string("%.2f", v.cast("double")))
    span = F.when(high.isNotNull() & (high != low), F.concat(sign, shown(low), F.lit("–"), shown(high))).otherwise(F.concat(sign, shown(low)))
    return F.when(F.coalesce(is_free, F.lit(False)), F.lit("Free")).when(low.isNull(), F.lit("")).otherwise(span)


def parse_price(raw: Column) -> Column:
    """struct(is_free, price_min, price_max, currency, price_text) from a price as written; all null from nothing."""
    t = F.nullif(F.trim(raw), F.lit(""))
    found = F.transform(F.regexp_extract_all(t, F.lit(PRICE_NUMBER), 1), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    read = F.struct(t.alias("t"), t.rlike(FREE_WORDS).alias("free"), found.alias("found"))

    def parsed(r: Column) -> Column:
        t, free = r["t"], r["free"]
        numbers = F.when(t.isNotNull() & ~free & (F.size(r["found"]) > 0), r["found"])
        return F.struct(
            F.when(free, True).when(numbers.isNotNull(), False).alias("is_free"),
            F.array_min(numbers).alias("price_min"),
            F.when(F.size(numbers) > 1, F.array_max(numbers)).alias("price_max"),
            F.when(numbers.isNotNull() & t.rlike("(?i)€|eur"), F.lit("EUR")).alias("currency"),
            t.alias("price_text"),
        )

    # A text is searched once for each pattern, however many fields are read.
    return F.get(F.transform(F.array(read), parsed), F.lit(0))


def free_ish(is_free: Column, price_min: Column) -> Column:
    return F.coalesce(is_free, F.lit(False)) | F.coalesce(price_min == 0, F.lit(False))
