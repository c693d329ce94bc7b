"""A/B experiment queries on the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.catalog.registry import query, rounded, table
from sievework.operators import events, experiment

# How the event types of the table stand in for the telemetry of an experiment.
NAMES = {"view": "tab_switch", "click": "button_click", "signup": "session_start", "purchase": " scroll ",
         "error": "ab_assignment"}


def assigned() -> Column:
    u = F.col("user_id")
    return F.when(u % 10 == 0, "(not set)").when(u % 2 == 0, "A").otherwise("B")


ASSIGNED = "CASE WHEN user_id % 10 = 0 THEN '(not set)' WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END"


@query("ab_version_counts", f"""
SELECT event_type AS event, count(*) FILTER (v = '(not set)') AS not_set, count(*) FILTER (v = 'A') AS "A",
    count(*) FILTER (v = 'B') AS "B", count(*) AS total FROM (SELECT event_type, {ASSIGNED} AS v FROM events) GROUP BY 1""")
def _(spark, folder):
    return events.version_counts(table(spark, folder, "events"), "event_type", assigned())


def sheet(spark, folder) -> DataFrame:
    """Count sheet as text, with a sum row, an empty name and a total that does not add up."""
    e = table(spark, folder, "events")
    name = F.lit(None)
    for kind, text in NAMES.items():
        name = F.when(F.col("event_type") == kind, text).otherwise(name)
    counts = events.version_counts(e.withColumn("event_type", name), "event_type", assigned())
    total = F.when(F.col("event") == "ab_assignment", F.col("total") + 1).otherwise(F.col("total"))
    rows = counts.withColumn("total", total)
    sums = rows.agg(F.lit("Grand Total").alias("event"), *[F.sum(c).alias(c) for c in ("not_set", "A", "B", "total")])
    blanks = rows.agg(F.lit("  ").alias("event"), *[F.max(c).alias(c) for c in ("not_set", "A", "B", "total")])
    both = rows.unionByName(sums).unionByName(blanks)
    return both.select("event", *[F.col(c).cast("string").alias(c) for c in ("not_set", "A", "B", "total")])


CLEANED = f"""cleaned AS (
    SELECT trim(event) AS event, not_set, "A", "B", total, not_set + "A" + "B" AS sum_check,
        CASE WHEN not_set + "A" + "B" = total THEN 1 ELSE 0 END::INTEGER AS total_match,
        CASE WHEN total > 0 THEN not_set / total END AS not_set_rate,
        1::INTEGER AS is_key_event
    FROM (SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())} END AS event,
        count(*) FILTER (v = '(not set)') AS not_set, count(*) FILTER (v = 'A') AS "A", count(*) FILTER (v = 'B') AS "B",
        count(*) + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS total
        FROM (SELECT event_type, {ASSIGNED} AS v FROM events) GROUP BY event_type))"""

PROXY = """proxy AS (SELECT 'session_start' AS session_proxy, max("A") FILTER (event = 'session_start') AS "n_A",
    max("B") FILTER (event = 'session_start') AS "n_B", CAST(sum("A") AS BIGINT) AS "total_A", CAST(sum("B") AS BIGINT) AS "total_B" FROM cleaned)"""

METRICS = """metrics AS (SELECT event, "A" AS "A_count", "B" AS "B_count", not_set AS not_set_count, round(not_set_rate, 6) AS not_set_rate,
    round("A" / "n_A", 6) AS "A_per_session", round("B" / "n_B", 6) AS "B_per_session",
    round("B" / "n_B" - "A" / "n_A", 6) AS "per_session_diff_B_minus_A", round("A" / "total_A", 6) AS "A_event_share",
    round("B" / "total_B", 6) AS "B_event_share" FROM cleaned, proxy)"""
METRIC_DIGITS = ("not_set_rate", "A_per_session", "B_per_session", "per_session_diff_B_minus_A", "A_event_share", "B_event_share")


def cleaned(spark, folder) -> DataFrame:
    return experiment.clean_event_counts(sheet(spark, folder))


@query("ab_clean_counts", f"WITH {CLEANED} SELECT * REPLACE (round(not_set_rate, 6) AS not_set_rate) FROM cleaned")
def _(spark, folder):
    return rounded(cleaned(spark, folder), 6, "not_set_rate")


@query("ab_event_quality", f"""
WITH {CLEANED} SELECT count(*) AS rows, CAST(sum(total_match) AS BIGINT) AS matches, CAST(sum(1 - total_match) AS BIGINT) AS mismatches,
    CAST(sum(is_key_event) AS BIGINT) AS key_events, count(*) + 2 AS raw_rows FROM cleaned""")
def _(spark, folder):
    raw = sheet(spark, folder)
    return experiment.event_quality(experiment.clean_event_counts(raw), raw)


@query("ab_session_proxy", f"WITH {CLEANED}, {PROXY} SELECT * FROM proxy")
def _(spark, folder):
    return experiment.session_proxy(cleaned(spark, folder))


@query("ab_event_metrics", f"WITH {CLEANED}, {PROXY}, {METRICS} SELECT * FROM metrics")
def _(spark, folder):
    return rounded(experiment.event_metrics(cleaned(spark, folder)), 6, *METRIC_DIGITS)


@query("ab_high_not_set", f"WITH {CLEANED} SELECT event, round(not_set_rate, 6) AS not_set_rate FROM cleaned WHERE not_set_rate > 0.09")
def _(spark, folder):
    return rounded(experiment.high_not_set(experiment.event_metrics(cleaned(spark, folder)), 0.09), 6, "not_set_rate")


@query("ab_untagged_assignment", f"""
WITH {CLEANED} SELECT coalesce(bool_or(event = 'ab_assignment' AND "A" = 0 AND "B" = 0), false) AS untagged FROM cleaned""")
def _(spark, folder):
    return experiment.untagged_assignment(experiment.event_metrics(cleaned(spark, folder)))


@query("ab_comparison_set", f"""
WITH {CLEANED}, {PROXY}, {METRICS} SELECT * FROM metrics WHERE event IN ('button_click', 'tab_switch', 'scroll')""")
def _(spark, folder):
    return rounded(experiment.comparison_set(experiment.event_metrics(cleaned(spark, folder))), 6, *METRIC_DIGITS)


# --- users ---


def users(spark, folder) -> DataFrame:
    """User-level table with repeated ids (users beyond 100 share one), odd labels and invalid rows."""
    e = table(spark, folder, "events")
    kind, value = F.col("event_type"), F.col("value")
    rolled = events.user_rollup(e, ["user_id"], {
        "tab_switches": F.count_if(kind == "view"),
        "button_clicks": F.count_if(kind == "click"),
        "guided_clicks": F.count_if((kind == "click") & (value > 40)),
        "scroll_count": F.count_if(kind == "signup"),
        "total_tab_duration_sec": F.round(F.sum(F.when(kind == "view", value)), 2),
        "avg_tab_duration_sec": F.round(F.avg(F.when(kind == "view", value)), 4),
        "session_duration_sec": F.round(F.max(value) - 120, 2),
        "unique_tabs_visited": F.count_distinct(kind),
        "reached_cleaning": (F.max(value) > 150).cast("int"),
        "reached_feature_eng": (F.count_if(kind == "purchase") >= 13).cast("int"),
        "reached_eda": (F.count_if(kind == "error") >= 13).cast("int"),
        "bounced": (F.count_if(kind == "signup") < 9).cast("int"),
        "linear_path_score": F.round(F.min(value), 2),
    })
    u = F.col("user_id")
    label = F.when(u % 10 == 0, F.lit(None)).when(u % 2 == 0, " a ").otherwise("B")
    depth = F.col("reached_cleaning") + F.col("reached_feature_eng") + F.col("reached_eda") + F.when(u % 17 == 0, 1).otherwise(0)
    return rolled.withColumns({"AB_Version": label, "workflow_depth": depth, "source_id": u}).withColumn("user_id", u % 100)


USERS = """raw AS (
    SELECT user_id % 100 AS user_id, user_id AS source_id,
        CASE WHEN user_id % 10 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS ab_version,
        (count(*) FILTER (event_type = 'view'))::DOUBLE AS tab_switches, (count(*) FILTER (event_type = 'click'))::DOUBLE AS button_clicks,
        (count(*) FILTER (event_type = 'click' AND value > 40))::DOUBLE AS guided_clicks, (count(*) FILTER (event_type = 'signup'))::DOUBLE AS scroll_count,
        round(sum(value) FILTER (event_type = 'view'), 2) AS total_tab_duration_sec, round(avg(value) FILTER (event_type = 'view'), 4) AS avg_tab_duration_sec,
        round(max(value) - 120, 2) AS session_duration_sec, count(DISTINCT event_type)::DOUBLE AS unique_tabs_visited,
        (max(value) > 150)::INTEGER AS reached_cleaning, (count(*) FILTER (event_type = 'purchase') >= 13)::INTEGER AS reached_feature_eng,
        (count(*) FILTER (event_type = 'error') >= 13)::INTEGER AS reached_eda, (count(*) FILTER (event_type = 'signup') < 9)::INTEGER AS bounced,
        round(min(value), 2) AS linear_path_score FROM events GROUP BY events.user_id),
deep AS (SELECT *, (reached_cleaning + reached_feature_eng + reached_eda + CASE WHEN source_id % 17 = 0 THEN 1 ELSE 0 END)::DOUBLE AS workflow_depth FROM raw),
one AS (SELECT * FROM deep QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY source_id) = 1),
flagged AS (SELECT *, CASE WHEN ab_version IN ('A', 'B') THEN 0 ELSE 1 END AS missing_ab_version,
    CASE WHEN session_duration_sec < 2 THEN 1 ELSE 0 END AS too_short FROM one),
valid AS (SELECT *, (workflow_depth >= 2)::INTEGER AS deep_engagement,
    (reached_cleaning = 1 AND (reached_feature_eng = 1 OR reached_eda = 1))::INTEGER AS completed_workflow,
    CASE WHEN button_clicks > 0 THEN guided_clicks / button_clicks ELSE 0 END AS guided_click_intensity,
    total_tab_duration_sec / unique_tabs_visited AS duration_per_tab, scroll_count / unique_tabs_visited AS scrolls_per_tab,
    button_clicks / unique_tabs_visited AS clicks_per_tab, guided_clicks / unique_tabs_visited AS guided_clicks_per_tab,
    reached_cleaning + reached_feature_eng + reached_eda AS workflow_stage_sum,
    (workflow_depth = reached_cleaning + reached_feature_eng + reached_eda)::INTEGER AS workflow_depth_match
    FROM flagged WHERE missing_ab_version = 0 AND too_short = 0)"""

CAPPED = ("tab_switches", "button_clicks", "guided_clicks", "scroll_count", "total_tab_duration_sec", "avg_tab_duration_sec",
          "session_duration_sec", "unique_tabs_visited", "workflow_depth", "linear_path_score", "guided_click_intensity",
          "duration_per_tab", "scrolls_per_tab", "clicks_per_tab", "guided_clicks_per_tab")
CAPS = "caps AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.99) AS cap_{c}" for c in CAPPED) + " FROM valid)"
PREPARED = f"{USERS}, {CAPS}, users AS (SELECT valid.*, " + ", ".join(
    f"least({c}, cap_{c}) AS {c}_clean" for c in CAPPED) + " FROM valid, caps)"
CLEAN = tuple(f"{c}_clean" for c in CAPPED)
DERIVED = ("guided_click_intensity", "duration_per_tab", "scrolls_per_tab", "clicks_per_tab", "guided_clicks_per_tab")


def prepared(spark, folder) -> DataFrame:
    return experiment.prepare_users(users(spark, folder), ["source_id"])


@query("ab_users_flags", f"""
WITH {USERS}
SELECT user_id, ab_version, missing_ab_version::INTEGER AS missing_ab_version, too_short::INTEGER AS too_short_session,
    (session_duration_sec < 0)::INTEGER AS invalid_negative_session_duration, 0::INTEGER AS invalid_negative_total_tab_duration,
    0::INTEGER AS invalid_negative_avg_tab_duration, 0::INTEGER AS invalid_negative_clicks,
    (missing_ab_version = 0 AND too_short = 0)::INTEGER AS valid_session FROM flagged""")
def _(spark, folder):
    out = experiment.flag_users(experiment.convert_users(users(spark, folder), ["source_id"]))
    return out.select("user_id", "ab_version", "missing_ab_version", "too_short_session", *experiment.NEGATIVE_FLAGS, "valid_session")


@query("ab_users_derived", f"""
WITH {USERS} SELECT user_id, ab_version, deep_engagement, completed_workflow, {', '.join(f'round({c}, 6) AS {c}' for c in DERIVED)},
    workflow_stage_sum, workflow_depth_match FROM valid""")
def _(spark, folder):
    out = prepared(spark, folder).select(
        "user_id", "ab_version", "deep_engagement", "completed_workflow", *DERIVED, "workflow_stage_sum", "workflow_depth_match")
    return rounded(out, 6, *DERIVED)


@query("ab_users_capped", f"WITH {PREPARED} SELECT user_id, {', '.join(f'round({c}, 6) AS {c}' for c in CLEAN)} FROM users")
def _(spark, folder):
    return rounded(prepared(spark, folder).select("user_id", *CLEAN), 6, *CLEAN)


@query("ab_caps", f"WITH {USERS}, {CAPS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(cap_{c}, 4) AS cap FROM caps" for c in CAPPED))
def _(spark, folder):
    return experiment.cap_summary(users(spark, folder), ["source_id"])


@query("ab_quality", f"""
WITH {USERS}
SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM raw) - (SELECT count(*) FROM one) AS duplicates_removed,
    (SELECT count(*) FROM one) AS rows_before_filter, (SELECT count(*) FROM valid) AS rows_after_filter,
    (SELECT count(*) FROM raw WHERE ab_version IS NULL) AS missing_version_raw,
    (SELECT count(*) FROM raw WHERE session_duration_sec < 2) AS too_short_raw,
    (SELECT count(*) FROM valid WHERE workflow_depth_match = 0) AS depth_mismatch,
    (SELECT count(*) FROM valid WHERE ab_version = 'A') AS "group_A", (SELECT count(*) FROM valid WHERE ab_version = 'B') AS "group_B" """)
def _(spark, folder):
    return experiment.quality(users(spark, folder), ["source_id"])


def _rate(c: str, name: str) -> str:
    return (f"round(avg({c}), 4) AS {name}_rate, round(greatest(0, avg({c}) - 1.96 * sqrt(avg({c}) * (1 - avg({c})) / count(*))), 4) AS {name}_ci_low, "
            f"round(least(1, avg({c}) + 1.96 * sqrt(avg({c}) * (1 - avg({c})) / count(*))), 4) AS {name}_ci_high")


@query("ab_core", f"""
WITH {PREPARED} SELECT ab_version, count(*) AS n, {_rate('deep_engagement', 'deep_engagement')}, {_rate('completed_workflow', 'completed_workflow')},
    round(avg(workflow_depth_clean), 4) AS mean_workflow_depth, round(avg(linear_path_score_clean), 4) AS mean_linear_path_score,
    round(avg(session_duration_sec_clean), 4) AS mean_session_duration_sec FROM users GROUP BY 1""")
def _(spark, folder):
    return experiment.core_summary(prepared(spark, folder))


@query("ab_funnel", f"""
WITH {USERS} SELECT ab_version, round(avg(reached_cleaning), 4) AS reached_cleaning_rate, round(avg(reached_feature_eng), 4) AS reached_feature_eng_rate,
    round(avg(reached_eda), 4) AS reached_eda_rate FROM valid GROUP BY 1""")
def _(spark, folder):
    return experiment.funnel(prepared(spark, folder))


@query("ab_style", f"""
WITH {PREPARED} SELECT ab_version, round(avg(tab_switches_clean), 4) AS mean_tab_switches, round(avg(button_clicks_clean), 4) AS mean_button_clicks,
    round(avg(guided_clicks_clean), 4) AS mean_guided_clicks, round(avg(guided_click_intensity_clean), 4) AS mean_guided_click_intensity,
    round(avg(unique_tabs_visited_clean), 4) AS mean_unique_tabs, {_rate('bounced', 'bounce')} FROM users GROUP BY 1""")
def _(spark, folder):
    return experiment.style(prepared(spark, folder))


@query("ab_sample_balance", f"WITH {USERS} SELECT ab_version, count(*) AS n FROM valid GROUP BY 1")
def _(spark, folder):
    return experiment.sample_balance(prepared(spark, folder))


@query("ab_primary_rate", f"WITH {USERS} SELECT ab_version, round(avg(deep_engagement) * 100, 6) AS rate_pct FROM valid GROUP BY 1")
def _(spark, folder):
    return rounded(experiment.rate_percent(prepared(spark, folder), "deep_engagement"), 6, "rate_pct")


@query("ab_secondary_rate", f"WITH {USERS} SELECT ab_version, round(avg(completed_workflow) * 100, 6) AS rate_pct FROM valid GROUP BY 1")
def _(spark, folder):
    return rounded(experiment.rate_percent(prepared(spark, folder), "completed_workflow"), 6, "rate_pct")


@query("ab_box_duration", f"""
WITH {PREPARED} SELECT ab_version, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS "min",
    round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS "max"
FROM (SELECT ab_version, session_duration_sec_clean AS x FROM users) GROUP BY 1""")
def _(spark, folder):
    out = experiment.box_by_version(prepared(spark, folder), "session_duration_sec")
    return rounded(out, 6, "mean", "std", "min", "q1", "median", "q3", "max")
