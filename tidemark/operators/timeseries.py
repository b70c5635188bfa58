"""Before/after stacks: pass grouping, stack selection, change features, mosaics and composites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import decibel, positive

#: Fixed values of stack selection and of the change score.
MOST_PRE, PRE_DAYS, POST_DAYS = 3, 40, 13
LEAST_SIGMA, SINGLE_DIVISOR = 0.8, 1.5
LEAST_COVER = 0.3
LEAST_CLEAR, ENOUGH_COVER, MOST_DATES = 0.15, 0.97, 3


def passes(items: DataFrame) -> DataFrame:
    """Frames of one pass: a row for each (date, track), in that order."""
    return items.groupBy("date", "track").agg(F.count("*").alias("n_items"), F.min("item").alias("first_item")).orderBy("date", "track")


def select_stacks(dates: DataFrame, event: str, most_pre: int = MOST_PRE, pre_days: int = PRE_DAYS, post_days: int = POST_DAYS) -> DataFrame:
    """track, date and phase of each stack: the first pass on or after the event and the last few before it.

    Both phases must be there. The windows bound what is read, so they are filters that reach the scan.
    """
    day = F.lit(event).cast("date")
    near = dates.where(F.col("date").between(F.date_sub(day, pre_days), F.date_add(day, post_days))).select("track", "date").distinct()
    phase = F.when(F.col("date") >= day, "post").otherwise("pre")
    away = F.abs(F.datediff("date", day))
    ranked = near.select("track", "date", phase.alias("phase"), away.alias("away"))
    place = F.row_number().over(Window.partitionBy("track", "phase").orderBy("away"))
    chosen = ranked.withColumn("place", place).where(F.col("place") <= F.when(F.col("phase") == "post", 1).otherwise(most_pre))
    phases = F.collect_set("phase").over(Window.partitionBy("track"))
    return chosen.withColumn("both", F.size(phases)).where("both = 2").select("track", "date", "phase")


def stack_summary(chosen: DataFrame, event: str) -> DataFrame:
    """A row for each track: post date, number of pre dates and days from the event to the post date, soonest and longest stack first."""
    post = F.max(F.when(F.col("phase") == "post", F.col("date")))
    return (
        chosen.groupBy("track")
        .agg(post.alias("post_date"), F.count_if(F.col("phase") == "pre").alias("n_pre"), F.datediff(post, F.lit(event).cast("date")).cast("long").alias("lag_days"))
        .orderBy("post_date", F.desc("n_pre"), "track")
    )


def change_features(obs: DataFrame, keys: list[str], power: str = "power") -> DataFrame:
    """Change in decibels after the event, and its score against the spread before it.

    ``obs`` has the keys, ``phase``, ``n_pre`` (pre passes of the whole stack) and a power. The mean before is
    taken in linear power, the spread in decibels; with one pre pass in the stack the change is divided
    by a constant instead.
    """
    pre, post = F.col("phase") == "pre", F.col("phase") == "post"
    level = obs.withColumn("power_ok", positive(power)).withColumn("level", decibel("power_ok"))
    stats = level.groupBy(*keys).agg(
        F.avg(F.when(pre, F.col("power_ok"))).alias("pre_power"),
        F.stddev_pop(F.when(pre, F.col("level"))).alias("sigma"),
        F.max(F.when(post, F.col("level"))).alias("post_db"),
        F.max("n_pre").alias("n_pre"),
    )
    delta = F.col("post_db") - decibel("pre_power")
    score = F.when(F.col("n_pre") == 1, F.col("delta") / SINGLE_DIVISOR).when(
        F.col("sigma").isNotNull(), F.col("delta") / F.greatest("sigma", F.lit(LEAST_SIGMA))
    )
    return stats.withColumn("delta", delta).withColumn("z", score).where("delta is not null").select(*keys, "delta", "z", "n_pre")


def covered_tracks(obs: DataFrame, value: str, least: float = LEAST_COVER) -> DataFrame:
    """Tracks of which enough pixels have a value."""
    return obs.groupBy("track").agg(F.avg(F.col(value).isNotNull().cast("int")).alias("cover")).where(F.col("cover") >= least)


def first_valid(frames: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Mosaic: of each key the value of the first frame that has one, by partial aggregation."""
    valid = F.col(value).isNotNull()
    return frames.groupBy(*keys).agg(F.min_by(value, F.when(valid, F.col(order))).alias(value), F.count_if(valid).alias("n_valid"))


def first_clear(dates: DataFrame, keys: list[str], mask_band: str, bands: list[str], order: str) -> DataFrame:
    """Composite: all bands of the first date whose mask band has a value, whatever the other bands have."""
    chosen = F.min_by(F.struct(order, *bands), order)
    return dates.where(F.col(mask_band).isNotNull()).groupBy(*keys).agg(chosen.alias("look")).select(*keys, "look.*")


def before_after(looks: DataFrame, keys: list[str], value: Column, time: str, event: str) -> DataFrame:
    """As-of both ways: the last clear look before the event and the first one after it, one aggregation."""
    at = F.lit(event).cast("timestamp_ntz")
    before, after = F.col(time) < at, F.col(time) >= at
    return looks.groupBy(*keys).agg(
        F.max_by(value, F.when(before, F.col(time))).alias("value_before"), F.min_by(value, F.when(after, F.col(time))).alias("value_after")
    )


def pick_dates(fractions: DataFrame, want: int = MOST_DATES, newest_first: bool = True) -> DataFrame:
    """Dates clear enough, newest or oldest first, until they cover enough together; the one that crosses stays.

    Cover is 1 - prod(1 - f); a product by folding has no trouble with a wholly clear date. There is a
    row for each date, so the ordered window is over a short list whatever the pixels behind it.
    """
    order = F.desc("date") if newest_first else F.asc("date")
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = fractions.where(F.col("clear") >= LEAST_CLEAR).withColumn("all", F.collect_list("clear").over(w))
    left = F.aggregate("all", F.lit(1.0), lambda acc, f: acc * (1 - f))
    prior = F.aggregate(F.slice("all", F.lit(1), F.size("all") - 1), F.lit(1.0), lambda acc, f: acc * (1 - f))
    return (
        seen.select("date", "clear", F.size("all").cast("long").alias("place"), (1 - left).alias("cover"), (1 - prior).alias("cover_before"))
        .where((F.col("cover_before") <= ENOUGH_COVER) & (F.col("place") <= want))
        .drop("cover_before")
    )
