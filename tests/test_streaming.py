"""De-duplication with bounded state."""

import datetime

import pytest

from tsforge.session import scratch_path
from tsforge.streaming.series import stream_dedupe_within, with_late

COLUMNS = ["series", "Timestamp", "SpotPrice"]
SCHEMA = "series string, Timestamp timestamp_ntz, SpotPrice string"


def landed_batches(spark, batches, delay):
    """Rows landed after all batches, one file each, and the number of records in state after every micro-batch."""
    path = scratch_path(spark, "batches")
    kept = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        # A new start from the checkpoint for every file.
        run = (
            stream_dedupe_within(source, COLUMNS, "Timestamp", delay).writeStream.format("parquet")
            .option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
        )
        run.awaitTermination()
        kept += [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]][-1:]
    records = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{path}/out"), records, kept


def test_state_falls_and_late_records_come_back(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    first = [("a", day(i % 40), str(i % 60)) for i in range(240)] + [(None, day(3), None)] * 3
    second = [("a", day(200 + i % 5), "1") for i in range(20)] + [("b", day(199), "7")]
    third = [("a", day(i % 40), str(i % 60)) for i in range(50)] + [("late", day(2), "9")] * 2 + [("a", day(300), "1")]
    landed, records, kept = landed_batches(spark, [first, second, third], "10 days")
    assert landed.count() == landed.distinct().count()
    assert landed.filter("series = 'late'").isEmpty()
    whole = with_late(landed, records, COLUMNS)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, records.distinct().collect()))
    assert kept[0] <= 122 and kept[-1] < 10  # records behind the watermark have left the state


def test_event_time_has_to_be_part_of_the_record(spark):
    with pytest.raises(ValueError):
        stream_dedupe_within(spark.createDataFrame([], SCHEMA), ["series"], "Timestamp", "1 day")
