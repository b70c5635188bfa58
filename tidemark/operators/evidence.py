"""Evidence and classes of a changed pixel: optical, radar and terrain rules with fixed thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, WATER, DEBRIS, CHANNEL = 0, 1, 2, 3


@dataclass(frozen=True)
class Rules:
    """Fixed thresholds of the detector."""

    ndvi_drop: float = 0.20
    ndvi_drop_weak: float = 0.10
    bsi_rise: float = 0.05
    bright_rise: float = 0.03
    z_strong: float = 3.0
    z_agree: float = 2.0
    ml_prob: float = 0.5
    water_vv_db: float = -15.0
    water_vh_db: float = -22.0
    water_drop_db: float = 3.0
    hand_water: float = 30.0
    hand_debris: float = 80.0
    max_slope: float = 35.0
    flat_slope: float = 5.0
    bank_hand: float = 60.0
    bank_slope: float = 60.0
    min_blob_ha: float = 0.3
    corridor_m: float = 150.0
    channel_hand: float = 6.0
    channel_zone: float = 10.0
    bare_ndvi: float = 0.20
    bare_bright: float = 0.08


def yes(c: Column) -> Column:
    """A condition that no data doesn't meet."""
    return F.coalesce(c, F.lit(False))


def terrain_gates(r: Rules = Rules()) -> dict[str, Column]:
    """Where debris and water can lie at all; unknown height or slope counts as too high and too steep."""
    hand, slope = F.coalesce("hand", F.lit(1e4)), F.coalesce("slope", F.lit(90.0))
    gorge = (hand <= r.bank_hand) & (slope <= r.bank_slope)
    plain = F.col("hand").isNull() & (slope <= r.flat_slope)
    return {
        "gate_debris": (hand <= r.hand_debris) & ((slope <= r.max_slope) | gorge),
        "gate_water": ((hand <= r.hand_water) | plain) & (slope <= r.max_slope),
    }


def optical_evidence(r: Rules = Rules()) -> dict[str, Column]:
    """Change and new water in clear looks before and after."""
    seen = F.col("pre_ndvi").isNotNull() & F.col("post_ndvi").isNotNull()

    def rise(index: str) -> Column:
        return F.coalesce(F.col(f"post_{index}") - F.col(f"pre_{index}"), F.lit(0.0))

    stripped = rise("ndvi") <= -r.ndvi_drop
    sediment = (rise("ndvi") <= -r.ndvi_drop_weak) & ((rise("bsi") >= r.bsi_rise) | (rise("bright") >= r.bright_rise))
    # Away from the channel a harvest strips ground too; fresh sediment leaves it bare and bright.
    fresh = yes(F.col("post_ndvi") <= r.bare_ndvi) & yes(F.col("post_bright") >= r.bare_bright)
    near_channel = yes(F.col("hand") <= r.channel_zone)
    return {
        "seen": seen,
        "optical_change": seen & (stripped | sediment) & (near_channel | fresh),
        "optical_water": seen & yes(F.col("post_mndwi") > 0) & yes(F.col("pre_mndwi") < 0),
    }


def track_flags(r: Rules = Rules()) -> dict[str, Column]:
    """Flags of one track's pixel: a cross-polarised score that is missing counts as 0, a co-polarised one rules out."""
    good = yes(F.col("good")) & F.col("z_vv").isNotNull()
    z = F.greatest(F.abs(F.coalesce("z_vv", F.lit(0.0))), F.abs(F.coalesce("z_vh", F.lit(0.0))))
    dark = yes(F.col("post_vv") <= r.water_vv_db) & yes(F.col("post_vh") <= r.water_vh_db)
    drop = yes(F.col("d_vv") <= -r.water_drop_db) | yes(F.col("d_vh") <= -r.water_drop_db)
    return {"strong": good & (z >= r.z_strong), "agree": good & (z >= r.z_agree), "radar_water": good & dark & drop}


def radar_vote(tracks: DataFrame, keys: list[str], r: Rules = Rules()) -> DataFrame:
    """Votes of all tracks: one strong, or two that agree, is a change."""
    flags = tracks.select(*keys, *[c.alias(n) for n, c in track_flags(r).items()])
    return flags.groupBy(*keys).agg(
        (F.bool_or("strong") | (F.count_if("agree") >= 2)).alias("radar_raw"), F.bool_or("radar_water").alias("radar_water"), F.count_if("agree").alias("n_agree")
    )


def outranked(radar: Column, seen: Column, optical: Column) -> Column:
    """A clear look that shows no change overrules the radar."""
    return radar & ~(seen & ~optical)


def class_of(changed: Column, water: Column, channel: Column) -> Column:
    """Later assignments win: debris, then water, then channel."""
    return F.when(channel, CHANNEL).when(water, WATER).when(changed, DEBRIS).otherwise(NONE).cast("int")


def confidence(cls: Column, optical: Column, radar: Column, model: Column) -> Column:
    n = optical.cast("int") + radar.cast("int") + model.cast("int")
    return F.when(cls == NONE, 0.0).when(cls == CHANNEL, 0.5).otherwise(F.greatest(F.least(0.35 + 0.25 * n, F.lit(1.0)), F.lit(0.0)))


def evidence_areas(pixels: DataFrame, names: list[str], pixel_m2: float) -> DataFrame:
    """km2 of affected pixels with each evidence, one row for each name."""
    sums = pixels.agg(*[(F.count_if(F.col(n) & (F.col("cls") > 0)) * pixel_m2 / 1e6).alias(n) for n in names])
    return sums.unpivot([], names, "evidence", "km2")


def local_incidence(slope: Column, aspect: Column, heading: Column, incidence: Column) -> Column:
    """Angle in degrees between the radar's look, to the right of its heading, and the slope's normal."""
    turn = F.radians(aspect) - F.radians(F.pmod(heading + 90, F.lit(360)))
    tilt, theta = F.radians(slope), F.radians(incidence)
    cosine = F.cos(tilt) * F.cos(theta) - F.sin(tilt) * F.sin(theta) * F.cos(turn)
    return F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))


def radar_visible(slope: Column, aspect: Column, heading: Column, incidence: Column) -> Column:
    """Neither laid over (a facing slope steeper than the incidence) nor in shadow nor foreshortened too much."""
    facing = F.cos(F.radians(aspect) - F.radians(F.pmod(heading + 90, F.lit(360)))) < 0
    local = local_incidence(slope, aspect, heading, incidence)
    return yes(~(facing & (slope > incidence)) & (local < 88) & (local >= 15))


#: Degrees from north of the two flight directions, and the swath's incidence range.
HEADING = {"ascending": -12.5, "descending": 192.5}
NEAR_INCIDENCE, FAR_INCIDENCE = 30.9, 46.0


def swath_incidence(position: Column, low: Column, high: Column) -> Column:
    """Incidence from a point's place between the footprint's extremes along the look direction."""
    share = (position - low) / F.greatest(high - low, F.lit(1.0))
    return NEAR_INCIDENCE + F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)) * (FAR_INCIDENCE - NEAR_INCIDENCE)
