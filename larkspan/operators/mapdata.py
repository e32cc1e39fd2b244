"""Street-map elements: which ones matter, what their tags say, and ways and relations brought to their points.

Elements are tables: nodes (id, lat, lon, tags), ways (id, refs, tags), relations (id, members, tags), with tags a map
of strings, refs an array of node ids and members an array of structs (type, ref, role). Resolution is by equi-joins on
ids, so it spreads as the elements do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres of a storey and of a pitched roof, and by a building's tag where nothing says more.
STOREY_M, ROOF_M, OTHER_M = 3.0, 2.0, 9.0
CLASS_M = {
    3.0: ["garage", "garages", "carport", "shed", "hut", "kiosk", "roof", "toilets", "service", "container", "bunker", "guardhouse"],
    4.0: ["greenhouse", "allotment_house"],
    6.0: ["barn", "farm_auxiliary", "stable", "cowshed", "sty"],
    8.0: ["house", "detached", "semidetached_house", "terrace", "bungalow", "farm", "cabin", "static_caravan"],
    10.0: ["industrial", "warehouse", "manufacture", "hangar", "storage_tank", "supermarket"],
    12.0: ["commercial", "office", "retail", "hotel", "school", "university", "college", "kindergarten", "hospital", "public", "civic", "government", "train_station", "transportation", "sports_hall", "stadium"],
    15.0: ["apartments", "residential", "dormitory"],
    20.0: ["church", "cathedral", "mosque", "synagogue", "temple"],
}
#: Tags of a layer's roads, rails, places and masts.
ROADS, RAILS = ["motorway", "trunk", "primary", "secondary"], ["rail", "light_rail", "subway"]
MASTS = ["mast", "tower", "communications_tower"]
PLACES = {"city": "city", "town": "town", "village": "village", "hamlet": "village", "suburb": "suburb", "quarter": "suburb", "neighbourhood": "suburb", "borough": "suburb"}


def tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))


def is_building() -> Column:
    return F.coalesce(tag("building") != "no", F.lit(False))


def road_class() -> Column:
    """motorway, trunk, primary, secondary (their links too) or rail; null for other ways."""
    road = F.regexp_replace(tag("highway"), "_link$", "")
    return F.when(road.isin(ROADS), road).when(tag("railway").isin(RAILS), "rail")


def site_kind() -> Column:
    return F.when(tag("natural") == "peak", "peak").when(tag("man_made").isin(MASTS), "tower")


def node_kind(places: dict[str, str] = PLACES) -> Column:
    """What a named point is: a place by its tag, else a peak or a tower."""
    kinds = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])
    return F.coalesce(F.when(tag("place").isNotNull(), F.try_element_at(kinds, tag("place"))), site_kind())


def wants_node() -> Column:
    return tag("name").isNotNull() & node_kind().isNotNull()


def wants_way(buildings: bool = True) -> Column:
    named = tag("name").isNotNull()
    wants = road_class().isNotNull() | (tag("highway").isNotNull() & named) | (named & F.coalesce(site_kind() == "tower", F.lit(False)))
    return wants | is_building() if buildings else wants


def wants_relation(buildings: bool = True) -> Column:
    postal = F.coalesce(tag("boundary") == "postal_code", F.lit(False))
    return postal | building_relation() if buildings else postal


def building_relation() -> Column:
    return F.coalesce(tag("type") == "multipolygon", F.lit(False)) & is_building()


def _leading(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"^[0-9.,]+", 0), ",", ".").try_cast("double")


def length_m(text: Column) -> Column:
    """Metres of a length tag's first value: 12, 12.5 m, 12,5, 40 ft, 40'6". Null if unreadable, or not within 0 to 1000."""
    first = F.trim(F.substring_index(text, ";", 1))
    inches = F.coalesce(_leading(F.regexp_extract(first, r"^[0-9.,]+\s*'\s*(.*)$", 1)), F.lit(0.0))
    feet = first.contains("'") | first.endswith("ft") | first.endswith("feet")
    v = F.when(feet, (_leading(first) + inches / 12.0) * 0.3048).otherwise(_leading(first))
    return F.when((v > 0) & (v < 1000), v)


def levels(text: Column) -> Column:
    """Storeys of a tag's first value, rounded; null if not 1 to 200."""
    n = F.round(_leading(F.trim(F.substring_index(text, ";", 1))))
    return F.when(n.between(1, 200), n.cast("int"))


def building_height() -> Column:
    """struct(height_m, source) of a building by its tags: its height, else its storeys and roof, else its class. Null for what isn't a building."""
    by_class = F.lit(OTHER_M)
    for metres, names in CLASS_M.items():
        by_class = F.when(tag("building").isin(names), metres).otherwise(by_class)
    roof = F.when(tag("roof:shape") == "flat", 0.0).otherwise(ROOF_M)
    tall, storeys = length_m(tag("height")), levels(tag("building:levels"))
    made = lambda v, s: F.struct(v.cast("double").alias("height_m"), F.lit(s).alias("source"))
    return F.when(is_building(), F.when(tall.isNotNull(), made(tall, "height")).when(storeys.isNotNull(), made(storeys * STOREY_M + roof, "levels")).otherwise(made(by_class, "default")))


def _members(relations: DataFrame) -> DataFrame:
    each = relations.select(F.col("id").alias("rel"), "tags", F.posexplode("members").alias("pos", "m")).filter("m.type = 'way'")
    return each.select("rel", "tags", "pos", F.col("m.ref").alias("way"), F.coalesce("m.role", F.lit("")).alias("role"))


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way, points (lat, lon in the order of the way). Refs to unknown nodes are dropped; a way left without any keeps an empty array."""
    refs = ways.select(F.col("id").alias("way"), F.posexplode("refs").alias("pos", "node"))
    at = refs.join(nodes.select(F.col("id").alias("node"), "lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL"), "node")
    gathered = at.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("p"))
    points = F.transform(F.coalesce("p", F.array().cast("array<struct<pos: int, lat: double, lon: double>>")), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return ways.select(F.col("id").alias("way")).join(gathered, "way", "left").select("way", points.alias("points"))


def resolved_ways(nodes: DataFrame, ways: DataFrame, relations: DataFrame, buildings: bool = True) -> DataFrame:
    """id, tags, points of the ways that matter by themselves. A non-inner member of a building relation is no building of its own."""
    own = ways.filter(wants_way(buildings))
    outlines = _members(relations.filter(wants_relation(buildings) & building_relation())).filter("role <> 'inner'").select(F.col("way").alias("id")).distinct().withColumn("_part", F.lit(True))
    held = own.join(outlines, "id", "left")
    tags = F.when(F.col("_part"), F.map_filter("tags", lambda k, _: k != "building")).otherwise(F.col("tags"))
    return held.select("id", tags.alias("tags")).join(way_points(own, nodes).withColumnRenamed("way", "id"), "id")


def resolved_relations(nodes: DataFrame, ways: DataFrame, relations: DataFrame, buildings: bool = True) -> DataFrame:
    """id, tags, members (role and points, in the relation's order). Members whose way is unknown are dropped."""
    wanted = relations.filter(wants_relation(buildings))
    members = _members(wanted)
    needed = ways.join(members.select(F.col("way").alias("id")).distinct(), "id", "left_semi")
    at = members.drop("tags").join(way_points(needed, nodes), "way")
    gathered = at.groupBy("rel").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "points"))).alias("m"))
    kept = F.transform(F.coalesce("m", F.array().cast("array<struct<pos: int, role: string, points: array<struct<lat: double, lon: double>>>>")), lambda m: F.struct(m["role"].alias("role"), m["points"].alias("points")))
    return wanted.select(F.col("id").alias("rel"), "tags").join(gathered, "rel", "left").select(F.col("rel").alias("id"), "tags", kept.alias("members"))


def named_points(nodes: DataFrame) -> DataFrame:
    """id, kind, name, lat, lon of the nodes a place list keeps."""
    return nodes.filter(wants_node()).select("id", node_kind().alias("kind"), tag("name").alias("name"), "lat", "lon")
