"""Inputs of the registered queries, built from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.config import PrepConfig
from tsforge.operators.calendar import align
from tsforge.operators.grid import fill_series, regular_grid, resample_mean
from tsforge.operators.position import chronological_split
from tsforge.operators.windows import day_signals
from tsforge.plans.candle_features import DAY_START, placed_signals
from tsforge.session import cut_lineage
from tsforge.sources.candles import CandleStar
from tsforge.sources.events import INTERVAL_SECONDS, bars_from_events

TZ = "US/Eastern"
SERIES = ["series"]
PAGE_ROWS = 1000
PAGE_OVERLAP = 100

HOURLY = PrepConfig(
    interval_name="Hour", tz=TZ, seconds_divisor=3600, n_back=6, n_forward=3, reduce_vector_sizes=False
)
MINUTELY = PrepConfig(interval_name="Minute", tz=TZ, seconds_divisor=60, n_back=30, n_forward=15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, interval: str = "Hour") -> DataFrame:
    return bars_from_events(table(spark, sf_dir, "events"), interval)


def star(spark: SparkSession, sf_dir: str, interval: str = "Hour") -> CandleStar:
    """Star schema of the bars. Ids are any unique numbers, here derived from the values."""
    flat = bars(spark, sf_dir, interval)
    published = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("pub_date")
    name_id = F.crc32("instrument").cast("long")
    fact = flat.select(
        (F.col("timestamp") * 1000 + F.pmod(name_id, F.lit(1000))).alias("id"),
        "o", "l", "h", "c",
        (F.col("volume").cast("long") + 7).alias("volume_id"),
        (F.col("timestamp") - 1_000_000_000).alias("timestamp_id"),
        name_id.alias("instrument_id"),
        F.lit(1).cast("long").alias("price_type_id"),
        F.lit(INTERVAL_SECONDS[interval]).cast("long").alias("interval_id"),
        published,
    )
    stamps = flat.select("timestamp").distinct()
    volumes = flat.select("volume").distinct()
    names = flat.select("instrument").distinct()
    return CandleStar(
        candlestick=fact,
        timestamp=stamps.select((F.col("timestamp") - 1_000_000_000).alias("id"), "timestamp", published),
        volume=volumes.select((F.col("volume").cast("long") + 7).alias("id"), "volume", published),
        instrument=names.select(
            F.crc32("instrument").cast("long").alias("id"),
            F.col("instrument").alias("name"),
            F.lit(0.02).alias("us_margin_requirement"),
            published,
        ),
        price_type=spark.range(1).select(
            F.lit(1).cast("long").alias("id"), F.lit("mid").alias("name"), published
        ),
        interval=spark.createDataFrame(
            [(60, "Minute", "M1"), (3600, "Hour", "H1")], "id long, name string, symbol string"
        ).withColumn("pub_date", published),
    )


def shift_lookup(spark: SparkSession) -> DataFrame:
    """Own choice of a session calendar: from 17:00 on a bar belongs to the next weekday."""
    weekday, hour = (F.col("id") / 24).cast("int"), (F.col("id") % 24).cast("int")
    return spark.range(7 * 24).select(
        weekday.alias("weekday_tz"),
        hour.alias("hour_tz"),
        F.when(hour >= 17, (weekday + 1) % 7).otherwise(weekday).cast("int").alias("weekday_shifted"),
    )


def aligned(spark: SparkSession, sf_dir: str, interval: str = "Hour") -> DataFrame:
    return align(bars(spark, sf_dir, interval), shift_lookup(spark), TZ)


def placed(spark: SparkSession, sf_dir: str, config: PrepConfig = HOURLY) -> DataFrame:
    return placed_signals(aligned(spark, sf_dir, config.interval_name), config).drop(DAY_START)


def grid(spark: SparkSession, sf_dir: str, config: PrepConfig = HOURLY) -> DataFrame:
    return regular_grid(placed(spark, sf_dir, config))


def days(spark: SparkSession, sf_dir: str, config: PrepConfig = HOURLY) -> DataFrame:
    return day_signals(placed(spark, sf_dir, config))


def spot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price records: one per order, the price as text, one series per order priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series"),
        F.col("o_orderdate").alias("Timestamp"),
        F.col("o_totalprice").cast("string").alias("SpotPrice"),
        F.col("o_orderkey"),
    )


def page_copies(records: DataFrame) -> DataFrame:
    """Records with the page they are on; those at the end of a page are on the next one as well.

    A page covers PAGE_ROWS consecutive order keys, so its size is fixed whatever the data.
    """
    page = F.floor(F.col("o_orderkey") / PAGE_ROWS)
    at_end = F.pmod("o_orderkey", F.lit(PAGE_ROWS)) >= PAGE_ROWS - PAGE_OVERLAP
    pages = F.when(at_end, F.array(page, page + 1)).otherwise(F.array(page))
    return records.withColumn("page", F.explode(pages)).drop("o_orderkey")


def spot_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping response pages as the price service delivers them: times as text, every other one with an offset
    of two hours, and the series among the fields of a record."""
    copies = page_copies(spot_records(spark, sf_dir))
    layout = "yyyy-MM-dd'T'HH:mm:ss"
    ahead = F.date_format(F.col("Timestamp") + F.expr("INTERVAL 2 HOURS"), layout)
    time = F.when(F.col("page") % 2 == 0, F.concat(F.date_format("Timestamp", layout), F.lit("Z"))).otherwise(
        F.concat(ahead, F.lit("+02:00"))
    )
    none = F.lit(None).cast("string")
    record = F.struct(
        none.alias("AvailabilityZone"), F.col("series").alias("InstanceType"), none.alias("ProductDescription"),
        "SpotPrice", time.alias("Timestamp"),
    )
    return copies.groupBy("series", "page").agg(
        F.collect_list(record).alias("SpotPriceHistory"),
        F.concat(F.lit("page-"), (F.col("page") + 1).cast("string")).alias("NextToken"),
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token of every page and the next one that it names; some pages were lost, and some lead back."""
    page, lost, back = F.col("page"), F.col("page") % 7 == 3, F.col("page") % 11 == 10
    landed = page_copies(spot_records(spark, sf_dir)).select("series", "page").filter(~lost)
    following = F.when(back, page - 4).otherwise(page + 1)
    return landed.select(
        "series", F.when(page > 0, F.concat(F.lit("page-"), page.cast("string"))).alias("token"),
        F.concat(F.lit("page-"), following.cast("string")).alias("next_token"),
    )


def spot_daily(spark: SparkSession, sf_dir: str, bin_seconds: int = 86_400) -> DataFrame:
    records = spot_records(spark, sf_dir).withColumn("price", F.col("SpotPrice").try_cast("double"))
    return resample_mean(records, SERIES, bin_seconds)


def spot_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series without gaps.

    Every later step reads the means more than once, so the records are scanned and averaged once.
    """
    return fill_series(cut_lineage(spot_daily(spark, sf_dir)), "spot_price", SERIES)


def spot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series with their chronological split."""
    return chronological_split(spot_series(spark, sf_dir), 0.9, SERIES)


def train_of(split: DataFrame) -> DataFrame:
    return split.filter("split = 'train'").select("series", "bin", "spot_price")


def horizon_of(split: DataFrame) -> DataFrame:
    """Length of the test set of every series."""
    return split.groupBy(*SERIES).agg(F.count(F.when(F.col("split") == "test", F.lit(1))).alias("h"))


def spot_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_of(spot_split(spark, sf_dir))
