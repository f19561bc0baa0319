"""Joins by distance, rank of distance and direction, blocked on a latitude-longitude grid.

Cells are at least as wide as the search radius, so a match lies in the same or an adjoining cell; one
side is given to its nine cells and the join is an equi-join on the cell.  Longitudes wrap at 180
degrees.  Near the poles a cell spans all longitudes.

Points may lie in clusters.  The nearest places of points in crowded cells are sought in cells a quarter
as wide, and so on until cells hold few places; and a cell that still holds many rows of both sides is
joined in blocks, so that no task has all of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.functions.geo import EARTH_KM, angle_between, bearing_deg, distance_km
from terrapanel.sources.shared import kept

#: Flyways by state, and their breeding and wintering points (latitude, longitude).
FLYWAY_STATES = {
    "Atlantic": ["CT", "DE", "FL", "GA", "ME", "MD", "MA", "NH", "NJ", "NY", "NC", "PA", "RI", "SC", "VT", "VA", "WV", "DC"],
    "Mississippi": ["AL", "AR", "IL", "IN", "IA", "KY", "LA", "MI", "MN", "MS", "MO", "OH", "TN", "WI"],
    "Central": ["CO", "KS", "MT", "NE", "NM", "ND", "OK", "SD", "TX", "WY"],
    "Pacific": ["AZ", "CA", "ID", "NV", "OR", "UT", "WA"],
}
FLYWAY_POINTS = {
    "Atlantic": ((58.0, -68.0), (28.0, -81.0)),
    "Mississippi": ((60.0, -100.0), (29.0, -91.0)),
    "Central": ((58.0, -108.0), (26.0, -98.0)),
    "Pacific": ((64.0, -150.0), (32.0, -115.0)),
}


#: Rows of each side of a cell that are joined in one block, and the most times that cells are quartered.
BLOCK = 4096
DEPTH = 12


class Grid:
    """Cells for a radius, valid up to a latitude."""

    def __init__(self, radius_km: float, top_lat: float):
        angle = radius_km / EARTH_KM
        self.lat_step = min(180.0, math.degrees(angle) * 1.0001)
        reach = math.cos(math.radians(min(89.999, abs(top_lat) + self.lat_step)))
        wide = math.sin(min(angle / 2, math.pi / 2)) / reach if reach > 0 else 2.0
        self.columns = 1 if wide >= 1 else max(1, int(360.0 / (math.degrees(2 * math.asin(wide)) * 1.0001)))

    def cell(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        return F.floor((lat + 90) / self.lat_step).cast("long"), F.floor(F.pmod(lon + 180, F.lit(360.0)) * self.columns / 360).cast("long")

    def located(self, df: DataFrame, lat: str, lon: str) -> DataFrame:
        """df with its cell, as cy and cx."""
        cy, cx = self.cell(F.col(lat), F.col(lon))
        return df.withColumn("cy", cy).withColumn("cx", cx)

    def around(self, df: DataFrame) -> DataFrame:
        """Located rows once for each cell at or beside their own."""
        beside = [0] if self.columns == 1 else [0, 1] if self.columns == 2 else [-1, 0, 1]
        cells = F.array(*(F.struct((F.col("cy") + i).alias("cy"), F.pmod(F.col("cx") + j, F.lit(self.columns)).alias("cx")) for i in (-1, 0, 1) for j in beside))
        return df.withColumn("cell", F.explode(cells)).drop("cy", "cx").select("*", "cell.cy", "cell.cx").drop("cell")


def _joined_cells(left: DataFrame, right: DataFrame, grid: Grid) -> DataFrame:
    """Rows of left beside rows of right in the same or an adjoining cell; both are located and have no other
    column in common.

    Cells that hold over BLOCK rows of right, and those beside them, are found by one aggregate.  Their rows
    are dealt into blocks by a hash of the row, and each block of left meets each of right as a group of its own;
    rows equal in all columns share a block.
    """
    near, cell = grid.around(left), ["cy", "cx"]
    many = right.groupBy(*cell).agg(F.count(F.lit(1)).alias("nr")).filter(F.col("nr") > BLOCK)
    crowded = kept(many, "crowded-cells")
    if crowded.isEmpty():
        return near.join(right, cell)
    counts = near.join(crowded, cell, "left_semi").groupBy(*cell).agg(F.count(F.lit(1)).alias("nl"))
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    blocks = kept(crowded.join(counts, cell).select(*cell, parts("nl").alias("ls"), parts("nr").alias("rs")), "cell-blocks")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))

    def dealt(df: DataFrame, own: str, other: str, n: str, m: str) -> DataFrame:
        row = F.xxhash64(*(c for c in df.columns if c not in cell))
        with_blocks = df.join(blocks, cell, "left").withColumn(own, F.pmod(row, one(n)).cast("int"))
        return with_blocks.withColumn(other, F.explode(F.sequence(F.lit(0), one(m) - 1))).drop("ls", "rs")

    return dealt(near, "li", "ri", "ls", "rs").join(dealt(right, "ri", "li", "rs", "ls"), [*cell, "li", "ri"]).drop("li", "ri")


def _top_lat(*frames: DataFrame) -> float:
    """The largest absolute latitude: one aggregate over each table."""
    tops = [f.agg(F.max(F.abs("lat"))).first()[0] for f in frames]
    return max((t for t in tops if t is not None), default=0.0)


def pairs_within(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """(id, other, distance_km, bearing_deg) for points of left and right (id, lat, lon) at a distance
    over 0 and up to radius_km; bearing is seen from id.  Rows without coordinates match nothing.  A cluster
    within the radius is itself the result, all its pairs; its cells are joined in blocks."""
    a, b = (f.select("id", "lat", "lon").dropna(subset=["lat", "lon"]) for f in (left, right))
    grid = Grid(radius_km, _top_lat(a, b))
    right_ = grid.located(b.toDF("other", "lat2", "lon2"), "lat2", "lon2")
    km = distance_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    joined = _joined_cells(grid.located(a, "lat", "lon"), right_, grid).withColumn("distance_km", km).filter((F.col("distance_km") > 0) & (F.col("distance_km") <= radius_km))
    return joined.select("id", "other", "distance_km", bearing_deg(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("bearing_deg"))


def proximity(places: DataFrame, radius_km: float) -> DataFrame:
    """Directed pairs (place, neighbour, distance_km, bearing_deg) of places (place, lat, lon)."""
    points = places.select(F.col("place").alias("id"), "lat", "lon")
    return pairs_within(points, points, radius_km).select(F.col("id").alias("place"), F.col("other").alias("neighbour"), "distance_km", "bearing_deg")


def _levels(points: DataFrame, targets: DataFrame, radius_km: float, top: float, most: int) -> list[tuple[float, DataFrame]]:
    """(radius, its points) from the given radius to the least: points go down to a quarter of a radius while
    there are over `most` targets in the cells around theirs."""
    levels = [(radius_km, points)]
    for _ in range(DEPTH):
        radius, own = levels[-1]
        grid = Grid(radius, top)
        cells = grid.located(targets, "lat", "lon").groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("n"))
        crowded = kept(grid.around(cells).groupBy("cy", "cx").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("cy", "cx"), "nearest-crowded")
        if crowded.isEmpty():
            break
        located = grid.located(own, "lat", "lon")
        inside = kept(located.join(crowded, ["cy", "cx"], "left_semi").select(*points.columns), "nearest-inside")
        if inside.isEmpty():
            break
        levels[-1] = (radius, located.join(crowded, ["cy", "cx"], "left_anti").select(*points.columns))
        levels.append((radius / 4, inside))
    return levels


def nearest(points: DataFrame, places: DataFrame, k: int, radius_km: float | None = None, growth: float = 3.0) -> DataFrame:
    """(id, place, distance_km, rank): the k nearest places of each point (id, lat, lon), rank from 0;
    equal distances in the order of place.

    Points are first sought within radius_km (by default one that would hold about 4 k places if these
    lay evenly), those in crowded cells within a quarter of it, a sixteenth and so on.  Those that find fewer
    than k are sought again in the next larger radius, beyond radius_km `growth` times as large, until all have
    k or the radius is the whole earth.  Of places at one coordinate only the first k can be an answer.
    """
    have = places.select("place", "lat", "lon").dropna(subset=["place", "lat", "lon"])
    first = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("place"))
    targets = kept(have.withColumn("r", first).filter(F.col("r") <= k).drop("r"), "nearest-places")
    open_ = points.select("id", "lat", "lon").dropna(subset=["lat", "lon"])
    n, low, high, west, east = have.agg(F.count(F.lit(1)), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if radius_km is None:
        area = max(1.0, (high - low) * 111.2) * max(1.0, (east - west) * 111.2 * math.cos(math.radians((high + low) / 2))) if n else 1.0
        radius_km = math.sqrt(area * 4 * k / max(n, 1) / math.pi) + 1
    order = Window.partitionBy("id").orderBy("distance_km", "place")
    out, whole, top = None, math.pi * EARTH_KM, _top_lat(open_, targets)
    km = distance_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    levels = _levels(open_, targets, min(radius_km, whole), top, 64 * (k + 1))
    radius_km, open_ = levels.pop()
    while True:
        radius_km = min(radius_km, whole)
        grid = Grid(radius_km, top)
        right = grid.located(targets.toDF("place", "lat2", "lon2"), "lat2", "lon2")
        near = _joined_cells(grid.located(open_, "lat", "lon"), right, grid).select("id", "place", km.alias("distance_km")).filter(F.col("distance_km") <= radius_km)
        ranked = near.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)
        if radius_km >= whole:
            return ranked if out is None else out.unionByName(ranked)
        ranked = kept(ranked, "nearest")  # later rounds read what this one has found
        full = ranked.filter(F.col("rank") == k - 1).select("id").distinct()
        done = ranked.join(full, "id", "left_semi")
        out = done if out is None else out.unionByName(done)
        open_ = kept(open_.join(full, "id", "left_anti"), "nearest-open")
        if levels:
            radius_km, wider = levels.pop()
            open_ = wider.unionByName(open_)
            continue
        if n < k or not open_.take(1):
            if n >= k:
                return out
            radius_km = whole
            continue
        radius_km *= growth


def snap(points: DataFrame, places: DataFrame) -> DataFrame:
    """(lat, lon, place, distance_km): the nearest place of each distinct coordinate, ties by place."""
    distinct = points.select("lat", "lon").dropna().distinct().withColumn("id", F.struct("lat", "lon"))
    found = nearest(distinct, places, 1)
    return found.select("id.lat", "id.lon", "place", "distance_km")


def migration_axis(places: DataFrame) -> DataFrame:
    """(place, flyway, breeding_bearing_deg, wintering_bearing_deg) of places (place, state, lat, lon) in a
    state that has a flyway; others are left out."""
    spark = places.sparkSession
    rows = [(s, f, *FLYWAY_POINTS[f][0], *FLYWAY_POINTS[f][1]) for f, states in FLYWAY_STATES.items() for s in states]
    known = spark.createDataFrame(rows, "state string, flyway string, blat double, blon double, wlat double, wlon double")
    joined = places.dropna(subset=["lat", "lon"]).join(F.broadcast(known), "state")
    toward = lambda p: bearing_deg(F.col("lat"), F.col("lon"), F.col(f"{p}lat"), F.col(f"{p}lon"))
    return joined.select("place", "flyway", toward("b").alias("breeding_bearing_deg"), toward("w").alias("wintering_bearing_deg"))


def sector_edges(pairs: DataFrame, axis: DataFrame, bearing: str, radius_km: float = 300.0, half_width_deg: float = 45.0, decay_km: float = 150.0) -> DataFrame:
    """(place, neighbour, weight): pairs within the radius whose bearing lies in the place's sector; the
    weight falls with distance."""
    near = pairs.filter(F.col("distance_km") <= radius_km).join(axis.select("place", bearing), "place")
    inside = near.filter(angle_between(F.col("bearing_deg"), F.col(bearing)) <= half_width_deg)
    return inside.select("place", "neighbour", F.exp(-F.col("distance_km") / decay_km).alias("weight"))
