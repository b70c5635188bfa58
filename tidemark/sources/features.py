"""Vector sources: tags, layers, geometries, snapshots, regions and dated files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags that are kept, and the values that put a feature in a layer.
KEEP_TAGS = (
    "name", "name:en", "name:ne", "highway", "bridge", "waterway", "place", "amenity", "healthcare", "building",
    "surface", "population", "layer", "tunnel", "ford", "natural", "man_made", "emergency", "landuse", "ref",
)
LAYERS = ("waterways", "water", "buildings", "roads", "bridges", "places", "health")
CONTEXT_LAYERS = ("roads_major", "health", "towns")
POLYGON_LAYERS = ("water", "buildings")
WATERWAYS = ("river", "stream", "canal", "drain")
MAJOR_ROADS = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "road", "motorway_link", "trunk_link", "primary_link", "secondary_link",
    "tertiary_link",
)
ROADS = (*MAJOR_ROADS, "residential", "living_street", "service", "track", "path", "footway", "steps", "bridleway")
PLACES = ("city", "town", "village", "hamlet", "suburb", "neighbourhood", "locality", "isolated_dwelling")
TOWNS = ("city", "town")


def kept_tags(tags: str | Column) -> Column:
    return F.map_filter(tags, lambda k, _: k.isin(*KEEP_TAGS))


def layers_of(kind: Column, tag) -> Column:
    """The layers of a feature, as an array; ``tag`` gives the column of a tag by its name."""
    way, node = kind == "way", kind == "node"
    bridge = tag("man_made") == "bridge"
    rules = {
        "waterways": way & tag("waterway").isin(*WATERWAYS),
        "water": way & ((tag("natural") == "water") | (tag("waterway") == "riverbank") | (tag("landuse") == "reservoir")),
        "buildings": way & tag("building").isNotNull(),
        "roads": way & tag("highway").isin(*ROADS),
        "roads_major": way & tag("highway").isin(*MAJOR_ROADS),
        "bridges": (way & ((tag("bridge") != "no") | bridge)) | (node & bridge),
        "places": node & tag("place").isin(*PLACES),
        "towns": node & tag("place").isin(*TOWNS),
        "health": tag("amenity").isin("hospital", "clinic", "doctors") | tag("healthcare").isin("hospital", "clinic", "centre", "doctor"),
    }
    return F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda x: x.isNotNull())


def classified(features: DataFrame, layers: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each feature (kind, tags) and layer that it belongs to: one scan for all layers."""
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    found = features.select("*", F.explode(layers_of(F.col("kind"), tag)).alias("layer"))
    return found.where(F.col("layer").isin(*layers)) if layers else found


def geometry_of(kind: Column, coords: Column, layer: Column) -> Column:
    """Point, Polygon or LineString by the element's kind, its ring and its layer; NULL where it has no place there."""
    closed = (F.size(coords) >= 4) & (F.get(coords, F.lit(0)) == F.element_at(coords, -1))
    area = layer.isin(*POLYGON_LAYERS)
    shape = F.when(kind == "node", "Point").when(closed & (area | (layer == "health")), "Polygon").when(~area & (F.size(coords) >= 2), "LineString")
    return F.when(shape.isNotNull(), F.struct(shape.alias("type"), coords.alias("coords")))


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def any_vertex_in(coords: str | Column, box: tuple[float, float, float, float]) -> Column:
    return F.exists(coords, lambda p: in_box(p["x"], p["y"], box))


def contains(outer: tuple[Column, Column, Column, Column], inner: tuple[Column, Column, Column, Column]) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def snapshot_at(history: DataFrame, key: str, start: str, when: Column) -> DataFrame:
    """The version of every key that was valid at a time: the last that had begun. One aggregation, no self-join."""
    rest = [c for c in history.columns if c not in (key, start)]
    last = F.max_by(F.struct(start, *rest), F.struct(start, *rest))
    return history.where(F.col(start) <= when).groupBy(key).agg(last.alias("v")).select(key, "v.*")


def tiled_union(tiles: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Union of overlapping tiles without repeats: of each key the first row in order."""
    rest = F.struct(*order, *[c for c in tiles.columns if c not in order])
    first = tiles.groupBy(key.alias("_key")).agg(F.min(rest).alias("r"))
    return first.select("r.*").select(*tiles.columns)


def marker_sections(rows: DataFrame, order: str, marker: str, *by: str) -> DataFrame:
    """Rows with the last marker seen before them: a reply that holds several answers is taken apart."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.last(marker, ignorenulls=True).over(w)).where(F.col(marker).isNull())


def choose_region(regions: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The region that covers most of a box, in steps of a twentieth; then the smaller, then by name."""
    west, south, east, north = box
    width = F.least("east", F.lit(east)) - F.greatest("west", F.lit(west))
    height = F.least("north", F.lit(north)) - F.greatest("south", F.lit(south))
    met = regions.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    cover = F.bround(width * height / ((east - west) * (north - south)) * 20) / 20
    size = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    return met.select("*", cover.alias("cover"), size.alias("size")).orderBy(F.desc("cover"), "size", "name").limit(1)


def candidate_dates(reference: Column) -> Column:
    """Dates for which a snapshot may exist: the last nine days, sixty firsts of months and the New Years since 2014, in that order."""
    days = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.date_sub(reference, k.cast("int")))
    months = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.add_months(F.trunc(reference, "month"), -k.cast("int")))
    year = F.year(reference)
    years = F.transform(F.sequence(F.lit(0), F.greatest(year - 2014, F.lit(0))), lambda k: F.make_date(year - k, F.lit(1), F.lit(1)))
    years = F.filter(years, lambda d: F.year(d) >= 2014)
    return F.filter(F.array_distinct(F.concat(days, months, years)), lambda d: d <= reference)
