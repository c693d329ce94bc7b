"""Event tables: dwell times, sessions, counts by version, one row per user.

A busy user may hold a large part of all events, so nothing here sorts all
events of a user in one task.  Time is cut into slots; windows run within
(user, slot) and a table with one row per user and slot carries values from
one slot to the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_SECONDS = 3600


def _instant(ts: str) -> Column:
    return F.col(ts).cast("timestamp")


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def _slotted(df: DataFrame, user: str, ts: str, slot_seconds: int) -> DataFrame:
    """Rows under private names, so that no column of the caller's is in the way."""
    return df.select(F.col(user).alias("__user"), _instant(ts).alias("__ts"),
                     *[F.col(c) for c in df.columns if c not in (user, ts)]).withColumn(
        "__slot", F.floor(F.unix_seconds("__ts") / slot_seconds))


def _neighbour(df: DataFrame, user: str, ts: str, order: Sequence[str], forward: bool,
               slot_seconds: int) -> DataFrame:
    """Events with ``__near``: the time of the next (or previous) event of the same user."""
    rows = _slotted(df, user, ts, slot_seconds)
    edge = F.min("__ts") if forward else F.max("__ts")
    shift = F.lead if forward else F.lag
    slots = rows.groupBy("__user", "__slot").agg(edge.alias("__edge"))
    other = shift("__edge").over(Window.partitionBy("__user").orderBy("__slot"))
    across = slots.select(F.col("__user").alias("__u"), F.col("__slot").alias("__s"), other.alias("__across"))
    within = Window.partitionBy("__user", "__slot").orderBy("__ts", *order)
    joined = rows.join(across, F.col("__user").eqNullSafe(F.col("__u")) & F.col("__slot").eqNullSafe(F.col("__s")))
    return joined.withColumn("__near", F.coalesce(shift("__ts").over(within), F.col("__across"))).drop("__u", "__s", "__across")


def dwell(events: DataFrame, user: str = "user_id", ts: str = "ts", order: Sequence[str] = ("event_id",),
          slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Events with ``dwell_seconds``: whole seconds until the user's next event, NULL for the last one."""
    out = _neighbour(events, user, ts, order, True, slot_seconds)
    seconds = F.floor(_seconds(F.col("__near"), F.col("__ts")) + 0.5).cast("long")
    return out.withColumn("dwell_seconds", seconds).drop("__near", "__slot").withColumnsRenamed({"__user": user, "__ts": ts})


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap_seconds: int = 1800,
             order: Sequence[str] = ("event_id",), slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """``user, session_start, session_end, n_events, duration_seconds``.

    A session ends when the user is quiet for longer than the gap.
    """
    rows = _neighbour(events, user, ts, order, False, slot_seconds)
    opens = F.col("__near").isNull() | (_seconds(F.col("__ts"), F.col("__near")) > gap_seconds)
    rows = rows.withColumn("__opened", F.when(opens, F.col("__ts")))
    # Last session opened before each slot.
    slots = rows.groupBy("__user", "__slot").agg(F.max("__opened").alias("__last"))
    upto = Window.partitionBy("__user").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    before = slots.select(F.col("__user").alias("__u"), F.col("__slot").alias("__s"), F.max("__last").over(upto).alias("__carried"))
    within = Window.partitionBy("__user", "__slot").orderBy("__ts", *order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.max("__opened").over(within), F.col("__carried"))
    joined = rows.join(before, F.col("__user").eqNullSafe(F.col("__u")) & F.col("__slot").eqNullSafe(F.col("__s")))
    found = joined.withColumn("session_start", start).groupBy("__user", "session_start").agg(
        F.max("__ts").alias("session_end"), F.count(F.lit(1)).alias("n_events"))
    return found.select(F.col("__user").alias(user), "session_start", "session_end", "n_events",
                        F.round(_seconds(F.col("session_end"), F.col("session_start"))).cast("long").alias("duration_seconds"))


def version_counts(events: DataFrame, event: str, version: Column) -> DataFrame:
    """``event, not_set, A, B, total`` from single events."""
    rows = events.select(F.col(event).alias("event"), version.alias("v"))
    return rows.groupBy("event").agg(
        F.count_if(~F.coalesce(F.col("v").isin("A", "B"), F.lit(False))).alias("not_set"),
        F.count_if(F.col("v") == "A").alias("A"), F.count_if(F.col("v") == "B").alias("B"),
        F.count(F.lit(1)).alias("total"))


def user_rollup(events: DataFrame, keys: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """One row per user (and version) with the given aggregates."""
    return events.groupBy(*keys).agg(*[c.alias(name) for name, c in metrics.items()])


def telemetry_metrics(event: str = "event", tab: str = "tab_name", label: str = "button_label",
                      seconds: str = "seconds") -> dict[str, Column]:
    """Aggregates that turn raw telemetry into the user-level experiment columns.

    The share of distinct tabs that were stages is left to the caller, as is
    any score of the path taken.
    """
    def on(name: str) -> Column:
        return F.col(event) == name

    def visited(name: str) -> Column:
        return F.coalesce(F.bool_or(on("tab_switch") & (F.lower(tab) == name)), F.lit(False)).cast("int")

    return {
        "tab_switches": F.count_if(on("tab_switch")),
        "button_clicks": F.count_if(on("button_click")),
        "guided_clicks": F.count_if(on("button_click") & F.lower(label).startswith("guide")),
        "scroll_count": F.count_if(on("scroll")),
        "total_tab_duration_sec": F.coalesce(F.sum(F.when(on("tab_duration"), F.col(seconds))), F.lit(0)),
        "avg_tab_duration_sec": F.avg(F.when(on("tab_duration"), F.col(seconds))),
        "session_duration_sec": F.max(F.when(on("session_duration"), F.col(seconds))),
        "unique_tabs_visited": F.count_distinct(F.when(on("tab_switch"), F.col(tab))),
        "reached_cleaning": visited("cleaning"),
        "reached_feature_eng": visited("feature engineering"),
        "reached_eda": visited("eda"),
        "bounced": (F.count_if(on("tab_switch") | on("button_click")) == 0).cast("int"),
    }
