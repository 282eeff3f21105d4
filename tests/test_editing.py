from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import hours as H
from tidewell.operators import facets
from tidewell.plans import editing


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_opt_outs_need_a_well_formed_token(spark):
    a, b = "0b7e1c2a-1111-4222-8333-944455556666", "0b7e1c2a-1111-4222-8333-944455556667"
    ins = spark.createDataFrame([(a, "x@t"), (b, "y@t"), (None, "z@t")], "id string, email string")
    left, told = editing.opt_out(ins, spark.createDataFrame([(a.upper(),), ("1 or 1=1",), ("0b7e1c2a-1111-4222-8333-944455556668",), (None,), (a,)], "token string"))
    assert rows(left.select("email")) == [("y@t",), ("z@t",)]
    assert {r.token: r.outcome for r in told.collect()} == {a: "removed", "1 or 1=1": "invalid", "0b7e1c2a-1111-4222-8333-944455556668": "already", None: "invalid"}
    assert editing.opt_in(left, ins.limit(1)).count() == 3


def test_dead_addresses_become_null(spark):
    df = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v"), (4, None)], "id int, image_url string")
    assert rows(editing.heal(df, "image_url", df.where("id = 1"))) == [(1, None), (2, None), (3, "v"), (4, None)]
    assert rows(editing.to_check(df, "image_url", 1)) == [("u", 2)]


def test_each_translated_field_has_its_own_guard(spark):
    kind = "id int, title string, title_original string, quote string, description string"
    picks = spark.createDataFrame([(1, "Kino", None, "кино", "tekst"), (2, "Kino", "Was", "plain", None), (3, "Kino", None, "q", "d"), (4, "Kino", None, "кино", "d")], kind)
    said = spark.createDataFrame([(1, "et", "Cinema", "film", "text"), (2, "et", "Cinema", "film", "text"), (3, "en", "Cinema", "film", "text"), (4, "et", " KINO ", "фильм", "d ")], "id int, lang string, title string, quote string, description string")
    assert rows(editing.translated(picks, said)) == [(1, "Cinema", "Kino", "film", "text"), (2, "Cinema", "Was", "plain", None), (3, "Kino", None, "q", "d"), (4, "Kino", None, "кино", "d")]


def test_reviews(spark):
    picks = spark.createDataFrame([(1, "A — pending review", True, None), (2, "- Pending Review ", True, None), (3, "B", True, None)], "id int, title string, pending_review boolean, archived_at timestamp")
    ids = picks.where("id < 3").select("id")
    assert rows(editing.approved(picks, ids)) == [(1, "A", False, None), (2, "- Pending Review ", False, None), (3, "B", True, None)]
    out = editing.rejected(picks, ids, F.lit("2026-06-01").cast("timestamp")).where("archived_at is not null")
    assert {r.id for r in out.collect()} == {1, 2}


def test_forms_forget_set_or_keep_a_place(spark):
    picks = spark.createDataFrame([(i, "t", 1.0, 2.0, "a", "osm", False) for i in (1, 2, 3)], "id int, title string, lat double, lng double, address string, coords_source string, coords_locked boolean")
    forms = spark.createDataFrame([(1, " n ", "", "", False, None), (2, "", "3", "4.5", True, True), (3, "t", "3", "", True, False), (4, "new", "5", "6", False, True)], "id int, title string, lat string, lng string, dragged boolean, locked boolean")
    assert rows(editing.form_saved(picks, forms)) == [(1, "n", None, None, None, None, False), (2, None, 3.0, 4.5, "a", "manual", True), (3, "t", 1.0, 2.0, "a", "osm", False), (4, "new", 5.0, 6.0, None, None, True)]


def test_open_shelf_never_calls_unknown_hours_open(spark):
    v = spark.createDataFrame([("a", "A", 59.43, 24.75, "Mo-Su 10:00-20:00"), ("b", "B", 59.50, 24.75, "24/7"), ("c", "C", None, None, "24/7"), ("d", "D", 59.43, 24.75, None), ("e", "E", 59.43, 24.75, "Mo-Su 21:00-22:00")], "id string, name string, lat double, lng double, h string").withColumn("hours", H.parse_hours(F.col("h")))
    assert [r.id for r in editing.open_shelf(v, F.lit(2), F.lit(720), (59.43, 24.75)).collect()] == ["a", "c"]
    assert [r.id for r in editing.open_shelf(v, F.lit(2), F.lit(720)).collect()] == ["a", "b", "c"]


def test_texts(spark):
    day = datetime(2026, 6, 1).date()  # a Monday
    one = spark.range(1).select(F.lit(1).alias("n"), F.lit(day).alias("today"), F.lit(datetime(2026, 6, 5).date()).alias("fri"))
    h = lambda *a, **k: one.select(editing.headline(*a, **k)).first()[0]
    assert h(F.col("n"), [], "tonight") == "1 thing tonight"
    assert h(F.col("n") + 1, ["gig"], "tonight", F.col("fri"), F.col("today")) == "2 gigs on Friday"
    assert h(F.col("n") + 1, ["gig", "film"], "", F.date_add("today", 1), F.col("today")) == "2 gig and film tomorrow"
    assert one.select(editing.subline(F.col("n") - 1, 1200)).first()[0] == ""
    changes = spark.createDataFrame([("T", "V", "Fri", "Sat", "19:00", None, False), ("U", "W", None, None, None, None, True)], "title string, venue string, old_day string, new_day string, old_time string, new_time string, gone boolean")
    assert [r.line for r in editing.changed_lines(changes).orderBy("title").collect()] == ["T — now Sat (was Fri 19:00)", "U — no longer listed (W)"]


def test_week_board_orders_days(spark):
    rows_ = [(1, "Sun", "b"), (2, "Tonight", "a"), (3, None, "c"), (4, "Mon", "d")]
    p = spark.createDataFrame([(i, d, t, "gig", True, None, datetime(2026, 6, i)) for i, d, t in rows_], "id int, day string, title string, kind string, this_week boolean, archived_at timestamp, valid_until timestamp")
    assert [r.id for r in editing.week_board(p).collect()] == [2, 4, 1, 3]
    assert [r.id for r in editing.week_board(p, until=("2026-06-02", "2026-06-03"), sort="title").collect()] == [2, 3]


@pytest.mark.parametrize("most", [None, 2])
def test_collected_counts_all_and_cuts_the_list(spark, most):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), (None, 5), ("b", None)], "g string, v int")
    got = {r.g: (r.ids, r.n) for r in facets.collected(df, ["g"], "v", most).collect()}
    assert got == {"a": ([1, 2, 3][:most], 3), None: ([5], 1), "b": ([], 0)}
