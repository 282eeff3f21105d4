"""Work that is done again and again against what the last time left: who holds tonight's place, and what each reader was
sent. The state is a table of versions, so a round that fails or is repeated leaves it as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Versions
from .lifecycle import rotate_tonight
from .rank import keep_best


def rotated(picks: DataFrame, today_name: str) -> tuple[DataFrame, DataFrame]:
    """(picks, one row: action, id). A live pick that holds tonight keeps it (noop, its id); else one of this week's is
    promoted, if there is any (noop without an id, if not). Decided in one plan, over one row each."""
    held = picks.where(F.coalesce(F.col("tonight"), F.lit(False)) & F.col("archived_at").isNull()).agg(F.min("id").alias("held"))
    wanted = rotate_tonight(picks.where(F.coalesce(F.col("this_week"), F.lit(False))), today_name).agg(F.min("id").alias("chosen"))
    act = held.crossJoin(wanted).select(F.when(F.col("held").isNull() & F.col("chosen").isNotNull(), "promoted").otherwise("noop").alias("action"), F.coalesce("held", "chosen").alias("id"))
    new = act.where(F.col("action") == "promoted").select("id", F.lit(True).alias("__new"))
    out = picks.join(F.broadcast(new), "id", "left").withColumn("tonight", F.coalesce(F.col("__new"), F.col("tonight"))).drop("__new")
    return out.select(*picks.columns), act


def rotate(table: Versions, today_name: str, note: str) -> DataFrame:
    """A round over the table of picks: a new version only if one is promoted; the note makes it safe to repeat."""
    picks, act = rotated(table.read(), today_name)
    done = act.collect()  # one row
    if done[0]["action"] == "promoted":
        table.write(picks, note)
    return table.spark.createDataFrame(done, "action string, id string")


def due(readers: DataFrame, saved: DataFrame, changes: DataFrame, sent: DataFrame | None) -> DataFrame:
    """(user_id, pick_id, changed_at, change): for each reader and saved pick its latest change, unless that was sent.
    readers: user_id, those who want mail; saved: (user_id, pick_id); changes: (pick_id, id, changed_at, change); sent:
    (user_id, pick_id, changed_at)."""
    latest = keep_best(changes, ["pick_id"], [F.desc_nulls_last("changed_at"), F.desc("id")]).drop("id")
    rows = saved.select("user_id", "pick_id").distinct().join(readers.select("user_id").distinct(), "user_id", "left_semi").join(latest, "pick_id")
    if sent is not None:
        before = sent.select("user_id", "pick_id", F.col("changed_at").alias("__sent"))
        rows = rows.join(before, ["user_id", "pick_id"], "left").where(F.col("__sent").isNull() | (F.col("changed_at") > F.col("__sent"))).drop("__sent")
    return rows.select("user_id", "pick_id", "changed_at", "change")


def digest_round(state: Versions, readers: DataFrame, saved: DataFrame, changes: DataFrame, note: str) -> DataFrame:
    """What a round sends. The state holds, for each reader and pick, the change sent last and the round that sent it, and is
    written before it is answered from; a round that is repeated sends what it sent then."""
    if not state.has(note):
        old = state.read() if state.latest() else None
        new = due(readers, saved, changes, old).withColumn("round", F.lit(note))
        if old is not None:
            new = new.unionByName(old.join(new.select("user_id", "pick_id"), ["user_id", "pick_id"], "left_anti"))
        state.write(new, note)
    (version,) = state.log().where(F.col("note") == note).select("version").first()
    return state.read(version).where(F.col("round") == note).drop("round")
