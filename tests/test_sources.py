import datetime as dt
import re
from dataclasses import replace

import pytest

from tsforge.catalog import fixtures as fx
from tsforge.session import cut_lineage, scratch_path, shared_root
from tsforge.sources.candles import candle_scan, drop_star, duplicate_bars, star_join, store_star
from tsforge.sources.events import bars_from_events
from tsforge.sources.spot import read_pages, read_series, records_of_pages, save_series
from tsforge.sources.splits import read_splits, split_summary, write_splits
from tsforge.streaming.series import merge_bins, run_to_end, stream_bins, stream_dedupe, stream_resample

SMALL = "/root/testdata/sf0.001"
T = dt.datetime


def test_scan_returns_the_bars_of_one_instrument(spark):
    star = fx.star(spark, SMALL)
    expected = fx.bars(spark, SMALL).filter("instrument = 'view'").select("instrument", "timestamp", "o", "l", "h", "c", "volume")
    assert sorted(candle_scan(star, "mid", "view", "Hour").collect()) == sorted(expected.collect())
    assert star_join(star).count() == fx.bars(spark, SMALL).count()
    assert duplicate_bars(star.candlestick).count() == 0
    assert duplicate_bars(star.candlestick.unionByName(star.candlestick.limit(3))).count() == 3


def exchanges(df):
    """Shuffles and sorted joins of the growing tables; the look-up of a name has its own plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange hashpartitioning\((timestamp|volume)_id#", plan)), plan.count("SortMergeJoin")


def test_stored_star_gives_the_same_bars_without_a_shuffle(spark):
    star = fx.star(spark, SMALL)
    stored = store_star(star, buckets=4, prefix="bars_test")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        assert sorted(star_join(stored).collect()) == sorted(star_join(star).collect())
        # As with dimensions too large to broadcast; the names of the scan are resolved before it starts.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plain, bucketed = (candle_scan(x, "mid", "view", "Hour") for x in (star, stored))
        assert exchanges(bucketed) == (0, 1)
        assert exchanges(plain)[0] >= 4
        assert sorted(bucketed.collect()) == sorted(plain.collect())
        files = spark.table("bars_test_candlestick").inputFiles()
        assert 1 <= len(files) <= 4
        twice = store_star(stored, buckets=2, prefix="bars_again")
        assert sorted(candle_scan(twice, "mid", "view", "Hour").collect()) == sorted(plain.collect())
        none = store_star(replace(star, candlestick=star.candlestick.limit(0)), buckets=2, prefix="bars_none")
        assert star_join(none).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for prefix in ("bars_test", "bars_again", "bars_none"):
            drop_star(spark, prefix)
    assert not spark.catalog.tableExists("bars_test_candlestick")


@pytest.mark.parametrize("name", ["mid", "ask"])
def test_dimension_must_match_once(spark, name):
    star = fx.star(spark, SMALL)
    if name == "mid":
        star = replace(star, price_type=star.price_type.unionByName(star.price_type))
    with pytest.raises(Exception, match="expected one row named"):
        candle_scan(star, name, "view", "Hour").collect()


def test_bars_break_ties_by_id(spark):
    at = T(2024, 1, 1, 0, 0, 30)
    events = spark.createDataFrame(
        [(2, at, "a", 5.0), (1, at, "a", 7.0), (3, at, "a", 6.0), (4, T(2024, 1, 1, 0, 1), "a", 1.0)],
        "event_id long, ts timestamp_ntz, event_type string, value double",
    )
    out = sorted(bars_from_events(events, "Minute").collect(), key=lambda r: r.timestamp)
    assert (out[0].o, out[0].l, out[0].h, out[0].c, out[0].volume) == (7.0, 5.0, 7.0, 6.0, 3)
    assert out[1].timestamp - out[0].timestamp == 60


def test_series_round_trip(spark):
    rows = spark.createDataFrame(
        [("x", T(2024, 9, 1), 0.0772), ("x", T(2024, 9, 2), None)], "series string, Timestamp timestamp_ntz, spot_price double"
    )
    path = scratch_path(spark, "test")
    save_series(rows, path, "series")
    assert sorted(map(str, read_series(spark, path, "series").collect())) == sorted(map(str, rows.collect()))


def test_series_offsets_are_resolved(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Timestamp,spot_price\n2024-09-01 02:00:00+02:00,0.5\n2024-09-02 00:00:00+00:00,0.6\n")
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        out = [r.Timestamp for r in read_series(spark, str(tmp_path)).orderBy("Timestamp").collect()]
        assert out == [T(2024, 9, 1), T(2024, 9, 2)]
    spark.conf.set("spark.sql.session.timeZone", before)


def test_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"SpotPriceHistory":[{"Timestamp":"2024-09-01T00:00:00","SpotPrice":"0.1"},'
        '{"Timestamp":"2024-09-02T00:00:00","SpotPrice":"0.2"}],"NextToken":"t"}\n'
        '{"SpotPriceHistory":[{"Timestamp":"2024-09-02T00:00:00","SpotPrice":"0.2"}],"NextToken":""}\n'
    )
    records = records_of_pages(read_pages(spark, str(tmp_path)))
    assert records.count() == 3 and records.distinct().count() == 2


def page(*records):
    fields = ", ".join('{"Timestamp": "%s", "SpotPrice": "0.1", "InstanceType": "%s"}' % r for r in records)
    return '{"SpotPriceHistory": [%s]}' % fields


def test_page_times_and_series(spark, tmp_path):
    times = ["2024-09-01T03:44:06+00:00", "2024-09-01T03:44:06Z", "2024-09-01T05:44:06.5+02:00", "2024-03-10T02:30:00Z", "2024-09-01 03:44:06"]
    (tmp_path / "p.json").write_text(page(*((t, k) for t in times for k in "xy")))
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        rows = records_of_pages(read_pages(spark, str(tmp_path))).collect()
        half = T(2024, 9, 1, 3, 44, 6, 500_000)
        found = {(r.InstanceType, r.Timestamp) for r in rows}
        assert found == {(k, t) for k in "xy" for t in (T(2024, 9, 1, 3, 44, 6), half, T(2024, 3, 10, 2, 30))}
        assert len(rows) == 10
    spark.conf.set("spark.sql.session.timeZone", before)


def test_page_with_a_broken_time_is_an_error(spark, tmp_path):
    (tmp_path / "p.json").write_text(page(("soon", "x")))
    with pytest.raises(Exception, match="not a time: soon"):
        records_of_pages(read_pages(spark, str(tmp_path))).collect()


def test_series_file_across_clock_changes(spark, tmp_path):
    times = ["2024-03-10 01:30", "2024-03-10 02:30", "2024-03-10 07:30", "2024-11-03 05:30", "2024-11-03 06:30"]
    (tmp_path / "s.csv").write_text("Timestamp,spot_price\n" + "".join(f"{t}:00+00:00,0.5\n" for t in times))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    out = sorted(str(r.Timestamp)[:16] for r in read_series(spark, str(tmp_path)).collect())
    spark.conf.set("spark.sql.session.timeZone", before)
    assert out == sorted(times)


def test_splits_round_trip(spark):
    rows = spark.createDataFrame([(0, "train"), (1, "train"), (2, "test"), (3, None)], "position long, split string")
    path = scratch_path(spark, "test")
    write_splits(rows, path)
    assert read_splits(spark, path).count() == 4
    assert [r.position for r in read_splits(spark, path, "test").collect()] == [2]
    assert {tuple(r) for r in split_summary(read_splits(spark, path)).collect()} == {("train", 2, 0), ("test", 1, 2), (None, 1, 3)}


def test_lineage_is_cut_into_the_shared_folder(spark):
    df = spark.range(10).selectExpr("id * 2 AS x")
    cut = cut_lineage(df)
    assert sorted(cut.collect()) == sorted(df.collect())
    assert shared_root(spark) == spark.sparkContext.getCheckpointDir().rstrip("/")


def stream_of(spark, rows, schema, files=1, per_batch=1_000):
    path = scratch_path(spark, "input")
    if files == 1:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    else:  # one file per row, in the order given
        for i, row in enumerate(rows):
            spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def test_stream_resample_emits_closed_windows(spark):
    rows = [("a", T(2024, 1, d, h), float(d)) for d in (1, 2, 3, 4) for h in (1, 13)]
    source = stream_of(spark, rows, "k string, ts timestamp_ntz, v double")
    out = run_to_end(spark, stream_resample(source, ["k"], "1 day", "1 hour", "ts", "v", "mean"), "test").collect()
    assert sorted((r.ts, r.mean) for r in out) == [(T(2024, 1, d), float(d)) for d in (1, 2, 3)]


# June before January, so that a watermark would call the latter late.
OUT_OF_ORDER = [("a", T(2024, m, d, 1), float(10 * m + d)) for m in (6, 1) for d in (5, 5, 7)]


@pytest.mark.parametrize("per_batch", [1, 100])
def test_merged_bins_are_complete(spark, per_batch):
    source = stream_of(spark, OUT_OF_ORDER, "k string, ts timestamp_ntz, v double", 6, per_batch)
    landed = run_to_end(spark, stream_bins(source, ["k"], "1 day", "ts", "v"), "test")
    out = merge_bins(landed, ["k"], "ts", "mean").collect()
    assert sorted((r.ts, r.mean) for r in out) == [(T(2024, m, d), float(10 * m + d)) for m in (1, 6) for d in (5, 7)]


@pytest.mark.parametrize("per_batch", [1, 100])
def test_stream_dedupe_loses_no_record(spark, per_batch):
    rows = [("a", T(2024, m, 1, 0, 0, 0, us), p) for m in (6, 1) for us in (250_000, 750_000) for p in ("1", None, "1")]
    source = stream_of(spark, rows, "k string, ts timestamp_ntz, p string", len(rows), per_batch)
    out = run_to_end(spark, stream_dedupe(source, ["k", "ts", "p"]), "test").collect()
    assert sorted(map(str, out)) == sorted(map(str, spark.createDataFrame(rows, "k string, ts timestamp_ntz, p string").distinct().collect()))
