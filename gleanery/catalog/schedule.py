"""Schedules, admission and call counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.catalog.registry import query, table
from gleanery.catalog.urls import HOST_OF_URL, HOST_URL
from gleanery.functions.urls import url_domain
from gleanery.operators import joint as J
from gleanery.operators import metering as M
from gleanery.operators import schedule as R

# SQL side: delay range and delay in microseconds of a URL.
_LOW = ("CASE domain WHEN 'mp.weixin.qq.com' THEN CAST(2.0 AS DOUBLE) WHEN 'zhuanlan.zhihu.com' THEN 1.5 "
        "WHEN 'juejin.cn' THEN 1.0 WHEN 'csdn.net' THEN 0.5 WHEN 'sspai.com' THEN 0.3 ELSE 0.5 END")
_HIGH = ("CASE domain WHEN 'mp.weixin.qq.com' THEN CAST(3.5 AS DOUBLE) WHEN 'zhuanlan.zhihu.com' THEN 2.5 "
         "WHEN 'juejin.cn' THEN 1.8 WHEN 'csdn.net' THEN 1.0 WHEN 'sspai.com' THEN 0.8 ELSE 1.2 END")
_UNIT = "CAST(('0x' || substr(md5(url), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE)"
_DELAY_US = f"CAST(floor((({_LOW}) + ({_UNIT}) * (({_HIGH}) - ({_LOW}))) * 1000000) AS BIGINT)"
_FRONTIER_SQL = f"""
    frontier AS (
        SELECT *, {_DELAY_US} AS delay_us FROM (
            SELECT page_id, {HOST_URL} AS url, {HOST_OF_URL} AS domain, page_id // 3 * 100000 AS arrival_us FROM pages))"""


def _frontier(spark, folder):
    pages = table(spark, folder, "pages").select(
        "page_id", F.expr(HOST_URL).alias("url"), F.expr("CAST(page_id DIV 3 * 100000 AS BIGINT)").alias("arrival_us"))
    delayed = R.with_domain_delay(pages.withColumn("domain", url_domain("url")))
    return delayed.withColumn("delay_us", R.delay_micros("url"))


@query("domain_delay", f"""
    WITH {_FRONTIER_SQL}
    SELECT page_id, domain, {_LOW} AS min_delay, {_HIGH} AS max_delay, delay_us FROM frontier""")
def domain_delay(spark, folder):
    return _frontier(spark, folder).select("page_id", "domain", "min_delay", "max_delay", "delay_us")


@query("politeness_schedule", f"""
    WITH {_FRONTIER_SQL},
    totals AS (SELECT *, sum(delay_us) OVER (PARTITION BY domain ORDER BY arrival_us, page_id) AS t FROM frontier)
    SELECT page_id, domain, CAST(t + max(arrival_us - t) OVER (PARTITION BY domain ORDER BY arrival_us, page_id) AS BIGINT)
        AS start_us FROM totals""")
def politeness_schedule(spark, folder):
    rows = _frontier(spark, folder).select("page_id", "domain", "arrival_us", "delay_us")
    return R.politeness_schedule(rows, "domain", "arrival_us", "page_id", "delay_us").select(
        "page_id", "domain", "start_us")


# Events squeezed in time, so that users and the whole have to wait.
_SQUEEZED_SQL = """
    squeezed AS (SELECT event_id, user_id, (epoch_us(ts) - 1704067200000000) // 2000 AS us,
                        (event_id * 7919) % 5000000 + 1000 AS delay_us FROM events)"""


def _squeezed(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "user_id", ((R.micros("ts") - 1704067200000000) / 2000).cast("bigint").alias("us"),
        (F.col("event_id") * 7919 % 5000000 + 1000).alias("delay_us"),
    )


@query("user_schedule", f"""
    WITH {_SQUEEZED_SQL},
    totals AS (SELECT *, sum(delay_us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS t FROM squeezed)
    SELECT event_id, user_id, CAST(t + max(us - t) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS start_us
    FROM totals""")
def user_schedule(spark, folder):
    return R.politeness_schedule(_squeezed(spark, folder), "user_id", "us", "event_id", "delay_us").select(
        "event_id", "user_id", "start_us")


@query("global_schedule", f"""
    WITH {_SQUEEZED_SQL},
    ranked AS (SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS i FROM squeezed),
    chained AS (SELECT *, i % 5 AS chain, i // 5 * 1010000 AS t FROM ranked)
    SELECT event_id, CAST(t + max(us - t) OVER (PARTITION BY chain ORDER BY i) AS BIGINT) AS global_us FROM chained""")
def global_schedule(spark, folder):
    return R.global_schedule(_squeezed(spark, folder).select("event_id", "us"), "us", "event_id").select(
        "event_id", "global_us")


def _joint_sql(rows: str, key: str, per_second: int, out: str) -> str:
    """SQL side: request by request, with all starts so far in a list and the place of the host's last one known."""
    return f"""
    WITH RECURSIVE {rows},
    placed AS (SELECT *, row_number() OVER (ORDER BY us, id) AS i FROM asked),
    linked AS (SELECT *, lag(i) OVER (PARTITION BY {key} ORDER BY i) AS p FROM placed),
    walk AS (
        SELECT i, [us] AS starts FROM linked WHERE i = 1
        UNION ALL
        SELECT l.i, list_append(w.starts, greatest(l.us, coalesce(w.starts[l.p] + l.delay_us, l.us),
            CASE WHEN l.i > {per_second} THEN w.starts[l.i - {per_second}] + 1010000 ELSE l.us END))
        FROM walk w JOIN linked l ON l.i = w.i + 1),
    starts AS (SELECT unnest(starts) AS start_us, generate_subscripts(starts, 1) AS i
               FROM (SELECT starts FROM walk ORDER BY i DESC LIMIT 1))
    SELECT {out}, start_us FROM starts s JOIN linked l ON s.i = l.i"""


@query("joint_schedule", _joint_sql(
    f"{_FRONTIER_SQL}, asked AS (SELECT page_id AS id, domain, arrival_us AS us, delay_us FROM frontier)", "domain", 5,
    "id AS page_id, domain"))
def joint_schedule(spark, folder):
    """Both spacings at once: between the requests to one host and between all."""
    rows = _frontier(spark, folder).select("page_id", "domain", "arrival_us", "delay_us")
    return J.joint_schedule(rows, "domain", "arrival_us", "page_id", "delay_us").rows.select("page_id", "domain", "start_us")


@query("trailing_rate", """
    SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS calls
    FROM events""")
def trailing_rate(spark, folder):
    events = table(spark, folder, "events").select("event_id", R.micros("ts").alias("us"))
    return R.trailing_rate(events, "us", window_us=3600 * R.SECOND).select("event_id", "calls")


@query("trailing_rate_by_user", """
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
        RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS calls
    FROM events""")
def trailing_rate_by_user(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", R.micros("ts").alias("us"))
    return R.trailing_rate(events, "us", ["user_id"], 86400 * R.SECOND).select("event_id", "calls")


def _admitted_sql(per: str, limit: int, window_us: int) -> str:
    """SQL side: call by call, keeping the last admitted times of each key."""
    return f"""
    WITH RECURSIVE calls AS (
        SELECT event_id, {per} AS k, epoch_us(ts) AS us,
               row_number() OVER (PARTITION BY {per} ORDER BY ts, event_id) AS n FROM events),
    walk AS (
        SELECT event_id, k, n, true AS admitted, [us] AS log FROM calls WHERE n = 1
        UNION ALL
        SELECT c.event_id, c.k, c.n, len(w.log) < {limit} OR c.us - w.log[1] >= {window_us},
               CASE WHEN len(w.log) < {limit} THEN list_append(w.log, c.us)
                    WHEN c.us - w.log[1] >= {window_us} THEN list_append(w.log[2:], c.us) ELSE w.log END
        FROM walk w JOIN calls c ON c.k = w.k AND c.n = w.n + 1)
    SELECT event_id, admitted, CASE WHEN admitted THEN 200 ELSE 429 END AS code FROM walk"""


def _calls(spark, folder):
    return table(spark, folder, "events").select("event_id", "user_id", R.micros("ts").alias("us"))


@query("admitted_calls", _admitted_sql("0", 2, 60_000_000))
def admitted_calls(spark, folder):
    """One log for all calls: two per minute."""
    return R.admit_calls(_calls(spark, folder), "us", "event_id", 2, 60 * R.SECOND).select("event_id", "admitted", "code")


@query("admitted_calls_by_user", _admitted_sql("user_id", 3, 86_400_000_000))
def admitted_calls_by_user(spark, folder):
    """One log per user: three per day."""
    return R.admit_calls(_calls(spark, folder), "us", "event_id", 3, 86400 * R.SECOND, per="user_id").select(
        "event_id", "admitted", "code")


# Which events are API calls.
_PATH = "CASE event_type WHEN 'click' THEN '/fetch' WHEN 'purchase' THEN '/batch-fetch' ELSE '/' END"
_CODE = "CASE WHEN event_id % 10 = 0 THEN 429 ELSE 200 END"
_CALLS_SQL = "event_type IN ('click', 'purchase') AND event_id % 10 <> 0"
_DAILY_SQL = f"""
    daily AS (SELECT CAST(ts + INTERVAL 8 HOURS AS DATE) AS date, count(*) AS count FROM events
              WHERE {_CALLS_SQL} GROUP BY 1)"""


def api_log(events):
    """Events as a call log: path and answer code planted."""
    return M.api_calls(events.withColumns({"path": F.expr(_PATH), "code": F.expr(_CODE)}), code="code")


def _daily(spark, folder, when: str = "true"):
    return M.daily_calls(api_log(table(spark, folder, "events").where(when)))


@query("api_calls", f"SELECT event_id FROM events WHERE {_CALLS_SQL}")
def api_calls(spark, folder):
    return api_log(table(spark, folder, "events")).select("event_id")


@query("daily_calls", f"WITH {_DAILY_SQL} SELECT date, count FROM daily")
def daily_calls(spark, folder):
    return _daily(spark, folder)


@query("today_calls", f"""
    WITH {_DAILY_SQL} SELECT coalesce(sum(count), 0)::BIGINT AS count FROM daily WHERE date = DATE '2024-01-15'""")
def today_calls(spark, folder):
    return M.today_calls(_daily(spark, folder), "2024-01-15")


@query("no_calls_today", f"""
    WITH {_DAILY_SQL} SELECT coalesce(sum(count), 0)::BIGINT AS count FROM daily WHERE date = DATE '1999-01-01'""")
def no_calls_today(spark, folder):
    return M.today_calls(_daily(spark, folder), "1999-01-01")


@query("total_calls", f"WITH {_DAILY_SQL} SELECT sum(count)::BIGINT AS count FROM daily")
def total_calls(spark, folder):
    return M.total_calls(_daily(spark, folder))


@query("daily_upsert", f"WITH {_DAILY_SQL} SELECT date, count FROM daily")
def daily_upsert(spark, folder):
    """Stored and pending counts added up, with one day in both."""
    stored = _daily(spark, folder, "ts < TIMESTAMP_NTZ '2024-01-15 12:00:00'")
    return M.upsert_daily(stored, _daily(spark, folder, "ts >= TIMESTAMP_NTZ '2024-01-15 12:00:00'"))
