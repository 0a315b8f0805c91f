from datetime import date, datetime, timezone

from gleanery.operators import metering as M


def _log(spark):
    at = lambda *a: datetime(*a, tzinfo=timezone.utc)
    return spark.createDataFrame([
        (at(2024, 1, 1, 15, 59, 59), "/fetch", 200), (at(2024, 1, 1, 16), "/batch-fetch", 500),
        (at(2024, 1, 1, 16), "/fetch", 429), (at(2024, 1, 1, 16), "/", 200), (at(2024, 1, 1, 16), "/fetch/", 200),
    ], "ts timestamp, path string, code int")


def test_only_answered_api_calls_count_by_local_day(spark):
    daily = M.daily_calls(M.api_calls(_log(spark), code="code"))
    assert sorted(map(tuple, daily.collect())) == [(date(2024, 1, 1), 1), (date(2024, 1, 2), 1)]
    utc = M.daily_calls(M.api_calls(_log(spark)), zone="UTC")
    assert [tuple(r) for r in utc.collect()] == [(date(2024, 1, 1), 3)]


def test_totals(spark):
    daily = M.daily_calls(M.api_calls(_log(spark), code="code"))
    assert M.today_calls(daily, date(2024, 1, 2)).first()["count"] == 1
    assert M.today_calls(daily, "2030-01-01").first()["count"] == 0
    assert M.total_calls(daily).first()["count"] == 2
    assert M.total_calls(daily.where("false")).first()["count"] == 0
    twice = M.upsert_daily(daily, daily)
    assert sorted(map(tuple, twice.collect())) == [(date(2024, 1, 1), 2), (date(2024, 1, 2), 2)]
