import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tsforge.catalog.fixtures import shift_lookup
from tsforge.functions.clock import epoch_seconds, local_wall_time, utc_wall_time
from tsforge.functions.numeric import day_cosine, day_sine, mean_of_present, price_to_double
from tsforge.operators.calendar import align, join_shift_lookup, session_date_by_join, with_local_time

NEW_YORK = ZoneInfo("US/Eastern")
BAR = "instrument string, timestamp long, o double, l double, h double, c double, volume int"


def epoch(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp())


def bars_at(spark, epochs):
    return spark.createDataFrame([("x", e, 1.0, 1.0, 1.0, 1.0, 1) for e in epochs], BAR)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_local_time_does_not_depend_on_the_session_zone(spark, zone):
    epochs = [epoch(2024, 3, 10, 6, 59), epoch(2024, 3, 10, 7, 0), epoch(2024, 11, 3, 5, 0),
              epoch(2024, 11, 3, 6, 0), epoch(1969, 12, 31, 23, 59), epoch(2024, 7, 1, 12, 34)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(e,) for e in epochs], "e long").select(
            "e",
            local_wall_time("e", "US/Eastern").cast("string").alias("t"),
            epoch_seconds(utc_wall_time("e")).alias("back"),
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for row in rows:
        expected = dt.datetime.fromtimestamp(row.e, NEW_YORK).strftime("%Y-%m-%d %H:%M:%S")
        assert row.t == expected
        assert row.back == row.e


def test_repeated_hour_keeps_instants_apart(spark):
    rows = with_local_time(bars_at(spark, [epoch(2024, 11, 3, 5), epoch(2024, 11, 3, 6)]), "US/Eastern")
    out = rows.select("timestamp", "hour_tz", "weekday_tz").collect()
    assert [r.hour_tz for r in out] == [1, 1] and [r.weekday_tz for r in out] == [6, 6]
    assert len({r.timestamp for r in out}) == 2


def test_session_dates(spark):
    monday_noon, friday_evening = epoch(2024, 1, 8, 17), epoch(2024, 1, 12, 23)
    sunday_evening = epoch(2024, 1, 14, 23)
    out = {
        r.timestamp: r.session_date
        for r in align(
            bars_at(spark, [monday_noon, friday_evening, sunday_evening]), shift_lookup(spark), "US/Eastern"
        ).collect()
    }
    assert out[monday_noon] == dt.date(2024, 1, 8)
    assert out[friday_evening] == dt.date(2024, 1, 13)
    assert out[sunday_evening] == dt.date(2024, 1, 15)


def test_unmatched_hour_keeps_its_date_and_both_ways_agree(spark):
    bars = bars_at(spark, [epoch(2024, 1, 8, h) for h in range(24)] + [epoch(2024, 1, 14, 23)])
    lookup = shift_lookup(spark).filter("hour_tz != 17")
    aligned = align(bars, lookup, "US/Eastern")
    direct = {r.timestamp: r.session_date for r in aligned.collect()}
    joined = {r.timestamp: r.session_date for r in session_date_by_join(aligned.drop("session_date")).collect()}
    assert direct == joined
    unmatched = aligned.filter("weekday_shifted is null").collect()
    assert unmatched and all(r.session_date == r.datetime_tz.date() for r in unmatched)


def test_lookup_with_two_answers_fails(spark):
    lookup = shift_lookup(spark).unionByName(shift_lookup(spark))
    local = with_local_time(bars_at(spark, [epoch(2024, 1, 8, 12)]), "US/Eastern")
    with pytest.raises(Exception, match="two rows"):
        join_shift_lookup(local, lookup).collect()


def test_typical_price_skips_missing(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, 2.0, 6.0), (2, None, 2.0, 6.0), (3, None, None, None), (4, float("nan"), 4.0, 6.0)],
        "id int, l double, h double, c double",
    ).select("id", mean_of_present("l", "h", "c").alias("m")).collect()
    assert {r.id: r.m for r in rows} == {1: 3.0, 2: 4.0, 3: None, 4: 5.0}


def test_seasonal_terms_have_unit_variance(spark):
    out = spark.range(0, 86400, 60).select(
        F.var_pop(day_sine("id")).alias("s"), F.var_pop(day_cosine("id")).alias("c")
    ).first()
    assert out.s == pytest.approx(1.0) and out.c == pytest.approx(1.0)


def test_malformed_price_is_null(spark):
    rows = spark.createDataFrame([("0.07",), ("x",), (None,)], "p string")
    assert [r[0] for r in rows.select(price_to_double("p")).collect()] == [0.07, None, None]
