"""Event and stream queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.catalog.registry import query, rounded, table
from sievework.catalog.testing import ASSIGNED, assigned
from sievework.operators import events, explore, features, scaling, text
from sievework.streaming import live


@query("dwell", """
SELECT event_id, user_id, CAST(floor((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 + 0.5) AS BIGINT) AS dwell_seconds
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(spark, folder):
    return events.dwell(table(spark, folder, "events")).select("event_id", "user_id", "dwell_seconds")


SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= {gap} * 1000000::BIGINT THEN 0 ELSE 1 END AS opens
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
sessions AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events,
    CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS duration_seconds FROM s GROUP BY user_id, s)"""


def plain_times(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("sessions", SESSIONS.format(gap=14400) + " SELECT * FROM sessions")
def _(spark, folder):
    out = events.sessions(table(spark, folder, "events"), gap_seconds=14400)
    return plain_times(out, "session_start", "session_end")


@query("user_rollup", f"""
SELECT user_id, {ASSIGNED} AS ab_version, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS clicks,
    round(sum(value), 2) AS total, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1, 2""")
def _(spark, folder):
    e = table(spark, folder, "events").withColumn("ab_version", assigned())
    out = events.user_rollup(e, ["user_id", "ab_version"], {
        "n_events": F.count(F.lit(1)), "clicks": F.count_if(F.col("event_type") == "click"),
        "total": F.sum("value"), "kinds": F.count_distinct("event_type")})
    return rounded(out, 2, "total")


# --- streams ---


def event_stream(spark, folder) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return live.open_stream(spark, folder, "events.parquet", schema)


@query("stream_counts", f"""
SELECT date_trunc('day', ts) AS window_start, event_type AS event, count(*) FILTER (v = '(not set)') AS not_set,
    count(*) FILTER (v = 'A') AS "A", count(*) FILTER (v = 'B') AS "B", count(*) AS total
FROM (SELECT ts, event_type, {ASSIGNED} AS v FROM events) GROUP BY 1, 2
HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(spark, folder):
    counts = live.stream_counts(event_stream(spark, folder), "event_type", assigned())
    return plain_times(live.drain(counts, "counts"), "window_start")


@query("stream_sessions", SESSIONS.format(gap=14400) + """
SELECT * FROM sessions WHERE session_end + INTERVAL 4 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(spark, folder):
    found = live.stream_sessions(event_stream(spark, folder), gap="4 hours")
    return plain_times(live.drain(found, "sessions"), "session_start", "session_end")


@query("stream_counts_closed", f"""
SELECT date_trunc('day', ts) AS window_start, event_type AS event, count(*) FILTER (v = '(not set)') AS not_set,
    count(*) FILTER (v = 'A') AS "A", count(*) FILTER (v = 'B') AS "B", count(*) AS total
FROM (SELECT ts, event_type, {ASSIGNED} AS v FROM events) GROUP BY 1, 2""")
def _(spark, folder):
    counts = live.stream_counts(event_stream(spark, folder), "event_type", assigned())
    return plain_times(live.drain(counts, "counts", live.open_counts), "window_start")


@query("stream_sessions_closed", SESSIONS.format(gap=14400) + " SELECT * FROM sessions")
def _(spark, folder):
    found = live.stream_sessions(event_stream(spark, folder), gap="4 hours")
    return plain_times(live.drain(found, "sessions", live.open_sessions), "session_start", "session_end")


@query("stream_clean", """
WITH f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
c AS (SELECT event_id, upper(event_type) AS event_type, least(value, q3 + 1.5 * (q3 - q1)) AS value FROM events, f WHERE user_id % 10 <> 0)
SELECT event_id, event_type, round(value, 6) AS value, round(ln(1 + value), 6) AS log_value FROM c""")
def _(spark, folder):
    fences = scaling.fit_fences(table(spark, folder, "events"), "value")
    stream = live.clean_stream(event_stream(spark, folder), [
        partial(explore.where, predicate="user_id % 10 <> 0"),
        partial(text.standardize, cols=["event_type"], case="upper"),
        partial(scaling.clip, column="value", lower=fences["lower_bound"], upper=fences["upper_bound"]),
        partial(features.log, column="value", check=False),
    ])
    out = live.drain(stream.select("event_id", "event_type", "value", "log_value"), "cleaned")
    return rounded(out, 6, "value", "log_value")


@query("stream_repeats", "SELECT event_id, user_id, event_type FROM events")
def _(spark, folder):
    twice = event_stream(spark, folder).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = live.drop_repeats(twice, ["event_id"])
    return live.drain(once.select("event_id", "user_id", "event_type"), "repeats")
