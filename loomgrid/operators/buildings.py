"""Typed map layers, footprints, visible walls and their ranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import geometry as G
from loomgrid.operators.ordering import prefix_sums
from loomgrid.operators.streets import listed, segments

#: Kinds of building with pitched roofs, and limits of walls.
PITCHED = ["house", "residential", "terrace", "semidetached_house", "detached", "bungalow", "cottage", "apartments", "church", "chapel", "school", "yes"]
PITCHED_SHAPES = ["gabled", "hipped", "half-hipped", "pyramidal"]
PITCHED_MAX_M2, BOXY = 500.0, 0.72
MIN_WALL_W_PX, MIN_WALL_H_PX, WINDOW_PITCH_M = 11.0, 9.0, 2.9
#: The tag selectors of each layer, as (element types, tag, pattern).
_ANY = ("node", "way", "relation")
LAYERS = {
    "water": [(("way", "relation"), "natural", "^water$"), (("way",), "waterway", "^(river|riverbank|stream|canal|dock)$"), (("relation",), "waterway", "^riverbank$")],
    "coastline": [(("way",), "natural", "^coastline$")],
    "roads": [(("way",), "highway", "^(motorway|trunk|primary|secondary|tertiary|unclassified|residential|living_street|pedestrian|service|motorway_link|trunk_link|primary_link|secondary_link|tertiary_link)$")],
    "rail": [(("way",), "railway", "^(rail|light_rail|tram|disused)$")],
    "green": [
        (("way",), "leisure", "^(park|garden|pitch|golf_course|recreation_ground|common)$"), (("relation",), "leisure", "^(park|garden|pitch|recreation_ground)$"),
        (("way",), "landuse", "^(grass|forest|meadow|cemetery|allotments|village_green|recreation_ground)$"), (("relation",), "landuse", "^(grass|forest|meadow|cemetery)$"),
        (("way",), "natural", "^(wood|scrub|grassland|wetland|sand|beach)$"),
    ],
    "buildings": [(("way", "relation"), "building", "")],
    "landuse_urban": [(("way",), "landuse", "^(residential|commercial|industrial|retail|railway|construction|brownfield|education)$"), (("way",), "amenity", "^parking$")],
    "poi": [
        (_ANY, "historic", "^(castle|memorial|monument|ruins|city_gate)$"), (_ANY, "amenity", "^(place_of_worship|university|hospital|townhall|theatre)$"), (_ANY, "tourism", "^(museum|attraction|artwork)$"),
        (_ANY, "leisure", "^sports_centre$"), (_ANY, "man_made", "^(bridge|chimney|tower|water_tower)$"), (_ANY, "railway", "^station$"),
    ],
}


def tag(name: str, tags: str = "tags") -> Column:
    return F.try_element_at(F.col(tags), F.lit(name))


def layer_selectors(elements: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """elements (type, id, tags, lat, lon) within (south, west, north, east) -> layer, type, id; one row for each layer of an element.

    One scan decides all layers.
    """
    south, west, north, east = bbox
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    hits = []
    for layer, selectors in LAYERS.items():
        any_of = F.lit(False)
        for types, key, pattern in selectors:
            any_of = any_of | (F.col("type").isin(*types) & F.coalesce(tag(key).rlike(pattern) if pattern else tag(key).isNotNull(), F.lit(False)))
        hits.append(F.when(any_of, F.lit(layer)))
    return elements.where(inside).select("type", "id", F.explode(F.array_compact(F.array(*hits))).alias("layer"))


def layer_number(layer_tag: Column) -> Column:
    """The layer tag as a whole number, 0 where it is none."""
    return F.coalesce(layer_tag.try_cast("double").cast("int"), F.lit(0))


def storeys(levels: Column, height: Column) -> Column:
    """(levels, tagged): the first of the levels, else of the height by storeys of 3.2 m, else two."""
    first = lambda c, sep: F.replace(F.trim(F.split_part(c, F.lit(sep), F.lit(1))), F.lit(","), F.lit(".")).try_cast("double")
    n = first(levels, ";")
    m = first(F.trim(height), " ")
    return (
        F.when((n > 0) & (n < 100), F.struct(n.alias("levels"), F.lit(True).alias("tagged")))
        .when((m > 0) & (m < 400), F.struct(F.greatest(F.lit(1.0), m / G.STOREY_M).alias("levels"), F.lit(True).alias("tagged")))
        .otherwise(F.struct(F.lit(2.0).alias("levels"), F.lit(False).alias("tagged")))
    )


def area_kind() -> Column:
    """What an area is: the first of leisure, landuse, natural and amenity, else `area`."""
    return F.coalesce(tag("leisure"), tag("landuse"), tag("natural"), tag("amenity"), F.lit("area"))


def water_split(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Water areas (polygons), and watercourses (ways of two points or more) with their width."""
    kind = F.coalesce(tag("natural"), tag("waterway"), F.lit("water"))
    water = elements.where(tag("natural").isNotNull() | tag("waterway").isNotNull()).withColumn("kind", kind)
    areas = water.where("polygon").select("id", "kind")
    ways = water.where("NOT polygon AND type = 'way' AND n_pts >= 2").select("id", "kind", F.when(F.col("kind").isin("river", "canal"), 6.0).otherwise(3.0).alias("width_m"))
    return areas, ways


def poi_anchor(elements: DataFrame) -> DataFrame:
    """Where a point of interest is: a node's own place, else its centre; without either it goes."""
    node = F.col("type") == "node"
    return elements.select("id", F.when(node, F.col("lat")).otherwise(F.col("center.lat")).alias("lat"), F.when(node, F.col("lon")).otherwise(F.col("center.lon")).alias("lon")).dropna(subset=["lat", "lon"])


def ring_accept(points: Column) -> Column:
    """A way's points as a closed ring: four with equal ends, or three and more that are then closed; else null."""
    closed = F.element_at(points, 1) == F.element_at(points, -1)
    return F.when((F.size(points) >= 4) & closed, points).when((F.size(points) >= 3) & ~closed, F.concat(points, F.slice(points, 1, 1)))


def edges(rings: DataFrame, key: str = "b_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """The edges of closed rings (key, seq, x, y)."""
    return segments(rings, key, extra)


def polygon_measures(ring_edges: DataFrame, key: str = "b_id") -> DataFrame:
    """Area and centroid from the edges; holes of the opposite winding subtract. Coordinates are taken from the ring's first corner."""
    w = Window.partitionBy(key)
    local = ring_edges.withColumns({"ox": F.min_by("ax", "seq").over(w), "oy": F.min_by("ay", "seq").over(w)})
    ax, ay, bx, by = (F.col(c) - F.col(o) for c, o in (("ax", "ox"), ("ay", "oy"), ("bx", "ox"), ("by", "oy")))
    cross = ax * by - bx * ay
    s = local.groupBy(key).agg(F.sum(cross).alias("c"), F.sum((ax + bx) * cross).alias("sx"), F.sum((ay + by) * cross).alias("sy"), F.first("ox").alias("ox"), F.first("oy").alias("oy"), F.avg(ax).alias("mx"), F.avg(ay).alias("my"))
    flat = F.abs("c") < 1e-12
    cx = F.when(flat, F.col("mx")).otherwise(F.col("sx") / (3 * F.col("c"))) + F.col("ox")
    cy = F.when(flat, F.col("my")).otherwise(F.col("sy") / (3 * F.col("c"))) + F.col("oy")
    return s.select(key, (F.abs("c") / 2).alias("area"), cx.alias("cx"), cy.alias("cy"))


def longest_edge(ring_edges: DataFrame, key: str = "b_id") -> DataFrame:
    """The bearing and length of each ring's longest edge, the first of equals; lengths count as equal to a micrometre."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return ring_edges.withColumn("length", F.hypot(dx, dy)).withColumn("bearing", G.bearing(dx, dy)).groupBy(key).agg(
        F.max_by(F.struct("bearing", "length"), F.struct(F.round("length", 6), -F.col("seq"))).alias("e")
    ).select(key, "e.*")


def visible_wall(ring_edges: DataFrame, levels: DataFrame, camera: G.Camera, key: str = "b_id") -> DataFrame:
    """Wall that shows: over edges that run rightwards on the canvas, their width by the wall's height in pixels.

    Rings of fewer than three edges show nothing.
    """
    ax, _ = camera.ground(F.col("ax"), F.col("ay"))
    bx, _ = camera.ground(F.col("bx"), F.col("by"))
    w = ring_edges.groupBy(key).agg(F.sum(F.when(bx >= ax, bx - ax).otherwise(0.0)).alias("width"), F.count("*").alias("n"))
    lift = F.col("levels") * camera.storey_px
    return w.join(levels, key).select(key, F.when(F.col("n") >= 3, F.col("width") * lift).otherwise(0.0).alias("visible_px"))


def viewport_cull(placed: DataFrame, camera: G.Camera, left: float, right: float, top: float, bottom: float) -> DataFrame:
    """Rows whose place (cx, cy) is on the canvas with margins in pixels; sx, sy are added."""
    sx, sy = camera.ground(F.col("cx"), F.col("cy"))
    seen = sx.between(-left, camera.width_px + right) & sy.between(-top, camera.height_px + bottom)
    return placed.withColumns({"sx": sx, "sy": sy}).where(seen)


def painted_margins(camera: G.Camera) -> dict[str, float]:
    """Margins that let half a large footprint and thirty storeys reach into the picture, at any cell size."""
    reach = 60.0 / camera.cell_m * G.CELL_W * 2**0.5
    return {"left": reach, "right": reach, "top": reach + 30.0 * camera.storey_px, "bottom": reach}


def roof_shape(tagged: Column, kind: Column, area: Column) -> Column:
    """The tagged shape, else gabled for small footprints of the pitched kinds, else flat."""
    guess = F.when((area <= PITCHED_MAX_M2) & kind.isin(PITCHED), "gabled").otherwise("flat")
    return F.coalesce(F.nullif(F.lower(tagged), F.lit("")), guess)


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points (n x 2) against the clock from the leftmost, by a monotone chain; points on its sides go."""
    p = np.unique(points, axis=0)  # by x, then y
    if len(p) < 3:
        return p
    if len(p) > 64:  # what is inside the hull of the extremes of eight directions can't be a corner
        turns = np.arange(8) * np.pi / 4
        q = p[np.unique(np.argmax(p @ np.stack([np.cos(turns), np.sin(turns)]), axis=0))]
        q = hull(q) if len(q) <= 64 else q
        e = np.roll(q, -1, axis=0) - q
        p = p[~np.all([ex * (p[:, 1] - y) - ey * (p[:, 0] - x) > 0 for (x, y), (ex, ey) in zip(q, e, strict=True)], axis=0)] if len(q) > 2 else p
    rows = p.tolist()

    def chain(way: list) -> list:
        out: list = []
        for x, y in way:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) - (out[-1][1] - out[-2][1]) * (x - out[-2][0]) <= 0:
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.asarray(chain(rows) + chain(rows[::-1]))


def smallest_box(corners: np.ndarray) -> tuple[float, ...] | None:
    """The smallest rectangle around a convex outline against the clock, along one of its sides, the first of equals to a square
    millimetre: ux, uy (the side's unit vector), and least and greatest places along and across it. None for a single point.

    The farthest corners along and across only move on as the sides turn, so they are followed around, not searched.
    """
    n = len(corners)
    if n < 2:
        return None
    p, best = corners.tolist(), None
    sides = range(n if n > 2 else 1)
    far = [0, 0, 0]  # the corners farthest along, across, and back
    for k in sides:
        (ax, ay), (bx, by) = p[k], p[(k + 1) % n]
        size = math.hypot(bx - ax, by - ay)
        if size <= 1e-9:
            continue
        ux, uy = (bx - ax) / size, (by - ay) / size
        along, across = lambda q, ux=ux, uy=uy: q[0] * ux + q[1] * uy, lambda q, ux=ux, uy=uy: q[1] * ux - q[0] * uy
        for m, (sign, axis) in enumerate(((1, along), (1, across), (-1, along))):
            j = max(far[m], k + 1, far[m - 1] if m else 0)
            while sign * axis(p[(j + 1) % n]) >= sign * axis(p[j % n]) and j < k + 2 * n:
                j += 1
            far[m] = j
        box = ux, uy, along(p[far[2] % n]), along(p[far[0] % n]), across(p[k]), across(p[far[1] % n])
        area = round((box[3] - box[2]) * (box[5] - box[4]), 6)
        if best is None or area < best[0]:
            best = area, box
    return best and best[1]


def small_boxes(p: np.ndarray) -> np.ndarray:
    """For rings of equally many points (rings x points x 2) what smallest_box finds of their hulls, a row each; nan for single points.

    The same chains and sides, for all rings together.
    """
    rings, size = p.shape[:2]
    rows = np.arange(rings)
    p = p[rows[:, None], np.lexsort((p[..., 1], p[..., 0]), axis=1)]
    single = np.concatenate([np.ones((rings, 1), bool), np.any(p[:, 1:] != p[:, :-1], axis=2)], axis=1)
    corners, held = np.zeros((rings, 2 * size, 2)), np.zeros(rings, np.int64)
    for way in (range(size), range(size - 1, -1, -1)):
        floor = held.copy()
        for k in way:
            q = p[:, k]
            while True:
                (ox, oy), (tx, ty) = corners[rows, held - 2].T, corners[rows, held - 1].T
                pops = single[:, k] & (held - floor > 1) & ((tx - ox) * (q[:, 1] - oy) - (ty - oy) * (q[:, 0] - ox) <= 0)
                if not pops.any():
                    break
                held[pops] -= 1
            on = rows[single[:, k]]
            corners[on, held[on]] = q[on]
            held[on] += 1
        held -= 1  # the chain's end begins the other
    best, found = np.full(rings, np.inf), np.full((rings, 6), np.nan)
    there = np.arange(2 * size) < held[:, None]
    for k in range(int(held.max(initial=0))):
        a, b = corners[:, k], corners[rows, (k + 1) % np.maximum(held, 1)]
        length = np.hypot(b[:, 0] - a[:, 0], b[:, 1] - a[:, 1])
        sides = (k < held) & (length > 1e-9) & ((held > 2) | (k == 0))
        u = (b - a) / np.where(sides, length, 1)[:, None]
        along = corners[..., 0] * u[:, :1] + corners[..., 1] * u[:, 1:]
        across = corners[..., 1] * u[:, :1] - corners[..., 0] * u[:, 1:]
        a0, a1 = np.where(there, along, np.inf).min(axis=1), np.where(there, along, -np.inf).max(axis=1)
        c0, c1 = across[:, k], np.where(there, across, -np.inf).max(axis=1)
        area = np.round((a1 - a0) * (c1 - c0), 6)
        less = sides & (area < best)
        best[less], found[less] = area[less], np.stack([u[:, 0], u[:, 1], a0, a1, c0, c1], 1)[less]
    return found


#: Points up to which rings of one size are boxed together.
SMALL_RING = 64
#: Points of which one task makes a hull at once.
HULL_POINTS = 50_000


def oriented_box(rings: DataFrame, key: str = "b_id") -> DataFrame:
    """The smallest rectangle around each ring: centre, unit vector of the long axis, lengths, area. A ring of a single point has none.

    The smallest one lies along a side of the convex hull. Rings of any size: vertices are dealt into parts, each part's hull is
    made, and the hulls' corners are put together for the last one.
    """
    point = F.struct("x", "y")
    sizes = rings.groupBy(key).agg(F.ceil(F.count("*") / HULL_POINTS).cast("int").alias("parts"))
    parts = rings.select(key, "x", "y").join(sizes, key).groupBy(key, "parts", F.pmod(F.xxhash64("x", "y"), "parts").alias("part")).agg(F.collect_list(point).alias("p"))

    def of_parts(batches):
        for pdf in batches:
            pdf["p"] = [[{"x": x, "y": y} for x, y in hull(np.asarray([(q["x"], q["y"]) for q in points])).tolist()] for points in pdf["p"]]
            yield pdf

    names = ["ux", "uy", "a0", "a1", "c0", "c1"]

    def of_rings(batches):
        for batch in batches:
            starts, sizes, points = listed(batch.column("p"))
            xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in "xy"], 1)
            box = np.full((len(sizes), 6), np.nan)
            for size in np.unique(sizes[sizes <= SMALL_RING]):
                box[sizes == size] = small_boxes(xy[starts[sizes == size, None] + np.arange(size)])
            for k in np.flatnonzero(sizes > SMALL_RING):
                box[k] = smallest_box(hull(xy[starts[k] : starts[k] + sizes[k]])) or np.nan
            has = ~np.isnan(box[:, 0])
            yield pa.RecordBatch.from_arrays([batch.column(key).filter(pa.array(has)), *box[has].T.copy()], names=[key, *names])

    if sizes.where("parts > 1").isEmpty():  # then no ring is dealt, and none needs its size
        whole = rings.groupBy(key).agg(F.collect_list(point).alias("p"))
    else:
        large = parts.where("parts > 1").mapInPandas(of_parts, parts.schema).groupBy(key).agg(F.flatten(F.collect_list("p")).alias("p"))
        whole = parts.where("parts = 1").select(key, "p").unionByName(large)
    kind = rings.schema[key].dataType.simpleString()
    best = whole.mapInArrow(of_rings, ", ".join([f"{key} {kind}", *[f"{c} double" for c in names]]))
    la, lc, ma, mc = F.col("a1") - F.col("a0"), F.col("c1") - F.col("c0"), (F.col("a0") + F.col("a1")) / 2, (F.col("c0") + F.col("c1")) / 2
    long = la >= lc
    return best.select(
        key, (ma * F.col("ux") - mc * F.col("uy")).alias("cx"), (ma * F.col("uy") + mc * F.col("ux")).alias("cy"), F.when(long, F.col("ux")).otherwise(-F.col("uy")).alias("vx"),
        F.when(long, F.col("uy")).otherwise(F.col("ux")).alias("vy"), F.greatest(la, lc).alias("long_m"), F.least(la, lc).alias("short_m"), (la * lc).alias("box_area"),
    )


def rigid_snap(rings: DataFrame, rotation: float, key: str = "b_id") -> DataFrame:
    """Every ring turned about its centroid until its longest edge has a clean bearing."""
    e = edges(rings, key)
    turn = longest_edge(e, key).withColumn("delta", F.radians(F.rint(G.rotated(F.col("bearing"), F.lit(rotation)) / 45.0) * 45.0 - G.rotated(F.col("bearing"), F.lit(rotation))))
    middle = polygon_measures(e, key).select(key, "cx", "cy")
    x, y = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    # bearings run clockwise
    return rings.join(turn.select(key, "delta"), key).join(middle, key).select(key, "seq", (F.col("cx") + x * F.cos("delta") + y * F.sin("delta")).alias("x"), (F.col("cy") - x * F.sin("delta") + y * F.cos("delta")).alias("y"))


def facade_layout(rings: DataFrame, buildings: DataFrame, camera: G.Camera, key: str = "b_id") -> DataFrame:
    """buildings (key, levels, shop) -> each wall's openings: columns, floors, windows, door, shop band, and whether it is seen and sunlit.

    Walls below 0.6 pixels are left out; walls too small for openings have none.
    """
    e = edges(rings, key)
    ax, ay = camera.ground(F.col("ax"), F.col("ay"))
    bx, by = camera.ground(F.col("bx"), F.col("by"))
    w = Window.partitionBy(key)
    wall = e.select(key, "seq", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("length_m"), ax.alias("gx"), ay.alias("gy"), bx.alias("hx"), by.alias("hy"))
    wall = wall.withColumns({"mx": F.avg("gx").over(w), "my": F.avg("gy").over(w)})
    nx, ny = F.col("hy") - F.col("gy"), -(F.col("hx") - F.col("gx"))
    inward = ((F.col("gx") + F.col("hx")) / 2 - F.col("mx")) * nx + ((F.col("gy") + F.col("hy")) / 2 - F.col("my")) * ny < 0
    sign = F.when(inward, -1.0).otherwise(1.0)
    wall = wall.withColumns({"width_px": F.hypot(F.col("hx") - F.col("gx"), F.col("hy") - F.col("gy")), "visible": ny * sign > 0, "sunlit": nx * sign < 0}).where("width_px >= 0.6").join(buildings, key)
    floors = F.greatest(F.lit(1), F.rint("levels").cast("int"))
    columns = F.least(F.greatest(F.lit(1), F.least(F.lit(12), F.rint(F.col("length_m") / WINDOW_PITCH_M).cast("int"))), F.greatest(F.lit(1), F.floor(F.col("width_px") / 4).cast("int")))
    detailed = (F.col("width_px") >= MIN_WALL_W_PX) & (F.col("levels") * camera.storey_px >= MIN_WALL_H_PX)
    windows = F.when(F.col("shop"), columns * (floors - 1)).otherwise(columns * floors - 1)
    return wall.select(
        key, "seq", "visible", "sunlit", detailed.alias("detailed"), F.when(detailed, columns).otherwise(0).alias("n_columns"), F.when(detailed, floors).otherwise(0).alias("floors"), F.when(detailed, windows).otherwise(0).alias("windows"),
        F.when(detailed, (~F.col("shop")).cast("int")).otherwise(0).alias("doors"), (detailed & F.col("shop")).alias("shop_band"),
    )


def frontage_label(tags: str = "tags") -> Column:
    """A building's name, else number and street, else street, else shop, amenity or kind of building."""
    t = lambda n: F.nullif(tag(n, tags), F.lit(""))
    return F.coalesce(t("name"), F.concat(t("addr:housenumber"), F.lit(" "), t("addr:street")), t("addr:street"), t("shop"), t("amenity"), t("building"), F.lit("building"))


def lookup_url(lat: Column, lon: Column) -> Column:
    """Where a frontage can be looked up by eye; the address is a fixed value."""
    return F.format_string("https://www.google.com/maps/@?api=1&map_action=pano&viewpoint=%.6f,%.6f", lat, lon)


def named_share(frontages: DataFrame) -> DataFrame:
    """Share of frontages (tags) that carry a name or a street; 0 without any."""
    told = F.coalesce(tag("name") != "", F.lit(False)) | F.coalesce(tag("addr:street") != "", F.lit(False))
    return frontages.agg(F.coalesce(F.avg(told.cast("int")), F.lit(0.0)).alias("share"))


def frontage_tags(frontages: DataFrame, elements: DataFrame) -> DataFrame:
    """Each frontage with its element's tags, none where there is no such element."""
    return frontages.join(elements.select("osm_id", "tags"), "osm_id", "left").withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))


def frontage_rank(walls: DataFrame, min_px: float = 200.0) -> DataFrame:
    """Frontages that show at least so much wall, most first; equals in the order of pos."""
    return walls.where(F.col("visible_px") >= min_px).orderBy(F.desc("visible_px"), "pos")


def wall_concentration(walls: DataFrame, shares: tuple[float, ...] = (0.5, 0.8, 0.9)) -> DataFrame:
    """share, n: how many frontages from the top hold each share of all wall; all of them where none do."""
    total = walls.agg(F.coalesce(F.nullif(F.sum("visible_px"), F.lit(0.0)), F.lit(1.0)).alias("total"), F.count("*").alias("rows"))
    summed = prefix_sums(walls, [F.desc("visible_px"), F.col("pos")], "visible_px").crossJoin(F.broadcast(total))
    hits = [F.min(F.when(F.col("running") / F.col("total") >= s, F.col("place"))).alias(f"s{k}") for k, s in enumerate(sorted(shares))]
    row = summed.agg(*hits, F.max("rows").alias("rows"))
    each = F.array(*[F.struct(F.lit(s).alias("share"), F.coalesce(f"s{k}", "rows", F.lit(0)).cast("long").alias("n")) for k, s in enumerate(sorted(shares))])
    return row.select(F.explode(each).alias("e")).select("e.*")


def wall_share(walls: DataFrame) -> DataFrame:
    """Add share: of all wall."""
    total = walls.agg(F.coalesce(F.nullif(F.sum("visible_px"), F.lit(0.0)), F.lit(1.0)).alias("total"))
    return walls.crossJoin(F.broadcast(total)).withColumn("share", F.col("visible_px") / F.col("total")).drop("total")


def worksheet(walls: DataFrame, limit: int = 200) -> DataFrame:
    """The top frontages with their number and their percentage of all wall."""
    top = wall_share(walls).orderBy(F.desc("visible_px"), "pos").limit(limit)
    return top.withColumn("n", F.row_number().over(Window.orderBy(F.desc("visible_px"), "pos")).cast("long")).withColumn("percent", F.col("share") * 100).drop("share")


def tagged_share(buildings: DataFrame) -> DataFrame:
    """Share of buildings with a tagged number of levels; 0 without buildings."""
    return buildings.agg(F.coalesce(F.avg(F.col("tagged").cast("int")), F.lit(0.0)).alias("share"))


def paint_stats(facades: DataFrame, buildings: DataFrame, roads: DataFrame, shores: DataFrame, masses: DataFrame) -> DataFrame:
    """One row of what a picture holds: buildings drawn (b_id, roof_tagged), detailed and shop facades that show, quay walls
    (shores, a row each), bridges among roads, landmarks (distinct osm of masses), their masses, and their names in order."""
    one = lambda df, *cols: df.agg(*cols)
    drawn = one(buildings, F.count("*").alias("buildings"), F.count_if("roof_tagged").alias("roofs_tagged"))
    walls = one(facades, F.count_if(F.col("visible") & F.col("detailed")).alias("facades_detailed"), F.count_if(F.col("visible") & F.col("shop_band")).alias("shopfronts"))
    marks = one(masses, F.count_distinct("osm").alias("landmarks"), F.count("*").alias("landmark_masses"), F.sort_array(F.collect_set("osm")).alias("landmarks_drawn"))
    out = drawn
    for other in (walls, one(shores, F.count("*").alias("quay_walls")), one(roads, F.count_if(F.col("bridge") & ~F.col("tunnel")).alias("bridges")), marks):
        out = out.crossJoin(F.broadcast(other))  # one row each
    return out


def coverage_check(corners: DataFrame, held: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """corners (x, y) of the ground that a picture shows, held (lat, lon) -> south, west, north, east of the ground in degrees, and
    exceeds: whether it reaches beyond the box of what is held. Without anything held it does."""
    lat, lon = G.inverse_transverse_mercator(F.col("x"), F.col("y"), *grid)
    at = corners.select(lat.alias("lat"), lon.alias("lon"))
    seen = at.agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))
    box = held.agg(F.min("lat").alias("a"), F.min("lon").alias("b"), F.max("lat").alias("c"), F.max("lon").alias("d"))
    beyond = (F.col("south") < F.col("a")) | (F.col("west") < F.col("b")) | (F.col("north") > F.col("c")) | (F.col("east") > F.col("d"))
    return seen.crossJoin(F.broadcast(box)).select("south", "west", "north", "east", F.coalesce(beyond, F.lit(True)).alias("exceeds"))  # one row each


def painter_order(placed: DataFrame) -> DataFrame:
    """Add place: back to front by the lowest point on the canvas (sy), then as they came, within each frame."""
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("frame").orderBy("sy", "pos")).cast("long"))


def frame_fit(points: DataFrame, rotation_deg: float, width_px: int, height_px: int, margin: float = 0.06, headroom_px: float = 0.0) -> DataFrame:
    """cell_m, origin_x, origin_y: the smallest cell, and the centre, that fit all points on the canvas; no points, no row."""
    import math

    usable_w, usable_h = width_px * (1 - 2 * margin), height_px * (1 - 2 * margin) - headroom_px
    if usable_w <= 0 or usable_h <= 0:
        raise ValueError("the margins leave no canvas")
    c, s = math.cos(math.radians(rotation_deg)), math.sin(math.radians(rotation_deg))
    u, v = F.col("x") * c - F.col("y") * s, F.col("x") * s + F.col("y") * c
    px, py = (u + v) * G.CELL_W, (u - v) * G.CELL_H
    b = points.agg(F.min(px).alias("x0"), F.max(px).alias("x1"), F.min(py).alias("y0"), F.max(py).alias("y1")).where("x0 IS NOT NULL")
    b = b.withColumn("cell_m", F.greatest((F.col("x1") - F.col("x0")) / usable_w, (F.col("y1") - F.col("y0")) / usable_h))
    mx = (F.col("x0") + F.col("x1")) / 2 / G.CELL_W
    my = ((F.col("y0") + F.col("y1")) / 2 - headroom_px * F.col("cell_m") / 2) / G.CELL_H
    cu, cv = (mx + my) / 2, (mx - my) / 2
    return b.select("cell_m", (cu * c + cv * s).alias("origin_x"), (cv * c - cu * s).alias("origin_y"))


def iso_metrics(frames: DataFrame) -> DataFrame:
    """frames (across_m, deep_m, cell_m, dpi, upscale, exaggeration) -> canvas size, ground covered, storey and metre in pixels, millimetres a pixel.

    Frames with a point on the river as it lies in the rotated ground's axes (river_u, river_v, in metres from the anchor) and
    the share of the height where it belongs (river_depth) also get shift_y, which moves the picture so that it is there.
    """
    root2 = F.sqrt(F.lit(2.0))
    even = lambda x: x.cast("int") + x.cast("int") % 2
    w = even(F.col("across_m") * 2 * G.CELL_W / (root2 * F.col("cell_m")))
    h = even(F.col("deep_m") * 2 * G.CELL_H / (root2 * F.col("cell_m")))
    storey = 2.0 * G.STOREY_M / F.col("cell_m") * F.col("exaggeration")
    out = frames.withColumns({"width_px": w, "height_px": h, "storey_px": storey, "metre_px": storey / G.STOREY_M, "mm_per_px": 25.4 * F.col("upscale") / F.col("dpi")})
    out = out.withColumns({"ground_across_m": F.col("width_px") * root2 * F.col("cell_m") / (2 * G.CELL_W), "ground_deep_m": F.col("height_px") * root2 * F.col("cell_m") / (2 * G.CELL_H)})
    if {"river_u", "river_v", "river_depth"} <= set(frames.columns):
        now = (F.col("river_u") - F.col("river_v")) / F.col("cell_m") * G.CELL_H + F.col("height_px") / 2
        out = out.withColumn("shift_y", F.col("river_depth") * F.col("height_px") - now)
    return out
