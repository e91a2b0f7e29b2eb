"""Street bearings, grid fits, rotation sweeps, and the relaxation of networks onto clean directions."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import geometry as G
from loomgrid.operators.ordering import prefix_sums
from loomgrid.operators.relaxing import relax, snapped
from loomgrid.sources.tables import stored

#: Carriageway widths in metres and ranks of road classes.
ROAD_WIDTH_M = {"motorway": 15.0, "trunk": 13.0, "primary": 12.0, "secondary": 10.0, "tertiary": 8.5, "unclassified": 7.0, "residential": 7.0, "living_street": 5.5, "pedestrian": 6.0, "service": 4.0}
LINKED = ["motorway", "trunk", "primary", "secondary", "tertiary"]
ROAD_RANK = {"motorway": 0, "trunk": 1, "primary": 2, "secondary": 3, "tertiary": 4, "unclassified": 5, "residential": 5, "living_street": 6, "pedestrian": 6, "service": 7}
#: Fixed value: vertices closer than this are one node.
NODE_M = 1.5
RAIL_WIDTH_M = 5.0


def _lookup(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def road_width(highway: Column) -> Column:
    """Width by class; links are 0.7 of their road; others 6 m."""
    return _lookup(ROAD_WIDTH_M | {f"{k}_link": ROAD_WIDTH_M[k] * 0.7 for k in LINKED}, highway, 6.0)


def road_importance(highway: Column) -> Column:
    """0 (motorway) to 7; what is not in the table, links too, is 7."""
    return _lookup(ROAD_RANK, highway, 7)


def roads_typed(elements: DataFrame, rail: bool = False) -> DataFrame:
    """elements (type, id, tags, n_pts) with a highway (or, with rail, a railway) of two points or more -> id, highway, name,
    width_m, bridge, tunnel, layer.

    Bridges and tunnels are tagged with anything but an empty text; a layer that is no number is 0. Rails are 5 m wide on layer 0.
    """
    t = lambda k: F.try_element_at("tags", F.lit(k))
    ways = elements.where((F.col("type") == "way") & (F.col("n_pts") >= 2) & t("railway" if rail else "highway").isNotNull())
    told = lambda k: F.coalesce(t(k) != "", F.lit(False)).alias(k)
    highway = F.lit("rail") if rail else t("highway")
    width = F.lit(RAIL_WIDTH_M) if rail else road_width(t("highway"))
    layer = F.lit(0) if rail else F.coalesce(t("layer").try_cast("double").cast("int"), F.lit(0))
    return ways.select("id", highway.alias("highway"), t("name").alias("name"), width.alias("width_m"), told("bridge"), told("tunnel"), layer.alias("layer"))


def segments(vertices: DataFrame, key: str = "road_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive vertices as segments: key, seq, ax, ay, bx, by, and the columns in `extra`."""
    w = Window.partitionBy(key).orderBy("seq")
    return vertices.select(key, *extra, "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx IS NOT NULL")


def segment_bearings(vertices: DataFrame, key: str = "road_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Each segment's bearing and length; those below a micrometre go."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return segments(vertices, key, extra).select(key, *extra, "seq", G.bearing(dx, dy).alias("bearing"), F.hypot(dx, dy).alias("length")).where("length >= 1e-6")


def bearing_rose(bearings: DataFrame, bins: int = 36) -> DataFrame:
    """bin, length: both directions of every segment, bins centred on multiples of their width; empty bins are 0."""
    width = 360.0 / bins
    both = bearings.select("length", F.explode(F.array(F.col("bearing"), F.col("bearing") + 180.0)).alias("b"))
    place = (F.floor((F.pmod("b", F.lit(360.0)) + width / 2) / width) % bins).cast("long")
    counted = both.groupBy(place.alias("bin")).agg(F.sum("length").alias("length"))
    every = bearings.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counted, "bin", "left").select("bin", F.coalesce("length", F.lit(0.0)).alias("length"))


def grid_fit(bearings: DataFrame, *by: str) -> DataFrame:
    """Fourth-harmonic mean of the bearings, in one pass: grid_angle, strength, total_length, n_segments; a group each."""
    angle = F.radians(4 * F.col("bearing"))
    sums = bearings.groupBy(*by).agg(F.sum(F.col("length") * F.cos(angle)).alias("c"), F.sum(F.col("length") * F.sin(angle)).alias("s"), F.sum("length").alias("total_length"), F.count("*").alias("n_segments"))
    sums = sums.where("total_length > 0")
    return sums.select(*by, F.pmod(F.degrees(F.atan2("s", "c")) / 4, F.lit(90.0)).alias("grid_angle"), (F.hypot("c", "s") / F.col("total_length")).alias("strength"), "total_length", "n_segments")


def rose_entropy(rose: DataFrame, bins: int = 36) -> DataFrame:
    """Entropy of a rose in bits, and orderliness: 1 for a perfect grid, 0 for none."""
    import math

    t = rose.agg(F.sum("length").alias("t"), F.sum(F.when(F.col("length") > 0, F.col("length") * F.log2("length")).otherwise(0.0)).alias("nl"))
    h = F.log2("t") - F.col("nl") / F.col("t")
    order = 1 - F.pow((h - 2) / (math.log2(bins) - 2), F.lit(2))
    return t.where("t > 0").select(h.alias("entropy"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), order)).alias("orderliness"))


def fit_rotation(angle: Column) -> Column:
    """Of angle - 90k, k = 0..3, the smallest in absolute value, the first of equals."""
    options = F.array(*[F.struct(F.abs(angle - 90.0 * k).alias("a"), F.lit(k).alias("k"), (angle - 90.0 * k).alias("v")) for k in range(4)])
    return F.array_min(options)["v"]


def rotation_sweep(bearings: DataFrame, rotations: list[float], extra: tuple[str, ...] = ()) -> DataFrame:
    """Every bearing with every rotation: rotation, offset, length; equal bearings are added up first."""
    merged = bearings.groupBy("bearing", *extra).agg(F.sum("length").alias("length"))
    return merged.select("length", *extra, "bearing", F.explode(F.array(*map(F.lit, rotations))).alias("rotation")).withColumn("offset", G.offset_from_clean(F.col("bearing"), F.col("rotation")))


def alignment_profile(bearings: DataFrame, step: float = 0.5, tolerance: float = 5.0) -> DataFrame:
    """rotation, share: length within the tolerance of a clean direction, for rotations from 0 below 45.

    An offset counts as within if it is so to nine decimals.
    """
    sweep = rotation_sweep(bearings, [k * step for k in range(int(45 / step))])
    share = F.sum(F.when(F.col("offset") <= tolerance + 1e-9, F.col("length")).otherwise(0.0)) / F.sum("length")
    return sweep.groupBy("rotation").agg(F.coalesce(share, F.lit(0.0)).alias("share"))


def best_rotation(profile: DataFrame) -> DataFrame:
    """The rotation of the largest share, the smallest of equals; shares count as equal to nine decimals."""
    return profile.agg(F.max_by("rotation", F.struct(F.round("share", 9), -F.col("rotation"))).alias("rotation"))


def snap_cost(bearings: DataFrame, rotation: float) -> DataFrame:
    """Length-weighted mean offset from the clean directions."""
    offset = G.offset_from_clean(F.col("bearing"), F.lit(rotation))
    return bearings.agg((F.sum(F.col("length") * offset) / F.sum("length")).alias("cost"))


def rotation_compare(bearings: DataFrame, core: Column, rotations: list[float], tolerance: float = 5.0) -> DataFrame:
    """rotation, and for the core and for all: share of clean length and mean bend, in one pass."""
    sweep = rotation_sweep(bearings.withColumn("core", core), rotations, ("core",))
    clean = F.when(F.col("offset") <= tolerance, F.col("length")).otherwise(0.0)
    inner = lambda c: F.sum(F.when(F.col("core"), c).otherwise(0.0))
    return sweep.groupBy("rotation").agg(
        (inner(clean) / inner(F.col("length"))).alias("core_share"), (inner(F.col("length") * F.col("offset")) / inner(F.col("length"))).alias("core_bend"),
        (F.sum(clean) / F.sum("length")).alias("city_share"), (F.sum(F.col("length") * F.col("offset")) / F.sum("length")).alias("city_bend"),
    )


def crisp_share(bearings: DataFrame, rotation: float, tolerance: float = 2.0) -> DataFrame:
    """Share of length within the tolerance of a clean direction; 0 without streets."""
    near = G.offset_from_clean(F.col("bearing"), F.lit(rotation)) <= tolerance
    return bearings.agg(F.coalesce(F.sum(F.when(near, F.col("length")).otherwise(0.0)) / F.sum("length"), F.lit(0.0)).alias("share"))


def radius_filter(vertices: DataFrame, x: float, y: float, radius: float = 450.0) -> DataFrame:
    """Roads whose line comes within the radius of a point."""
    s = segments(vertices)
    fx, fy = G.segment_foot(F.lit(x), F.lit(y), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return s.groupBy("road_id").agg(F.min(F.hypot(fx - x, fy - y)).alias("distance")).where(F.col("distance") <= radius)


def node_keys(vertices: DataFrame) -> DataFrame:
    """Add kx, ky: the node a vertex belongs to."""
    return vertices.withColumns({"kx": F.rint(F.col("x") / NODE_M).cast("long"), "ky": F.rint(F.col("y") / NODE_M).cast("long")})


def node_first_seen(vertices: DataFrame) -> DataFrame:
    """kx, ky, x, y: every node where its first vertex is."""
    first = node_keys(vertices).groupBy("kx", "ky").agg(F.min_by(F.struct("x", "y"), F.struct("road_id", "seq")).alias("p"))
    return first.select("kx", "ky", "p.x", "p.y")


def dedupe_consecutive(vertices: DataFrame) -> DataFrame:
    """Without vertices of the same node as the one before."""
    w = Window.partitionBy("road_id").orderBy("seq")
    marked = node_keys(vertices).withColumns({"px": F.lag("kx").over(w), "py": F.lag("ky").over(w)})
    return marked.where("px IS NULL OR px <> kx OR py <> ky").drop("px", "py")


def network_links(vertices: DataFrame) -> DataFrame:
    """Links between the nodes of consecutive vertices."""
    w = Window.partitionBy("road_id").orderBy("seq")
    chain = dedupe_consecutive(vertices).select(F.col("kx").alias("a_kx"), F.col("ky").alias("a_ky"), F.lead("kx").over(w).alias("b_kx"), F.lead("ky").over(w).alias("b_ky"))
    return chain.where("b_kx IS NOT NULL")


def network_relax(vertices: DataFrame, rotation: float, iterations: int = 60, anchor: float = 0.04, min_length: float = 4.0) -> DataFrame:
    """Nodes of a street network after relaxation: kx, ky, x, y. Roads share nodes, so junctions stay joined."""
    vertices = stored(vertices.select("road_id", "seq", "x", "y"), "vertices")  # read twice
    return relax(node_first_seen(vertices), network_links(vertices), rotation, iterations, anchor, min_length)


def relaxed_roads(vertices: DataFrame, nodes: DataFrame) -> DataFrame:
    """The roads rebuilt from their nodes' places, without vertices that fell together."""
    w = Window.partitionBy("road_id").orderBy("seq")
    chain = dedupe_consecutive(vertices).select("road_id", "seq", "kx", "ky").join(nodes, ["kx", "ky"])
    moved = chain.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))).where("step IS NULL OR step > 1e-6")
    return moved.select("road_id", "seq", "x", "y").withColumn("n", F.count("*").over(Window.partitionBy("road_id"))).where("n >= 2").drop("n")


def _settled(home: np.ndarray, rotation: float, iterations: int, anchor: float) -> np.ndarray:
    """Rings of equally many vertices (rings x vertices x 2) after relaxation; fewer than four vertices stay."""
    if home.shape[1] < 4:
        return home
    at = home.copy()
    length = np.hypot(*np.moveaxis(np.roll(home, -1, axis=1) - home, 2, 0))
    pulls = length >= 1e-9
    n = (pulls.astype(float) + np.roll(pulls, 1, axis=1))[..., None]
    for _ in range(iterations):
        after = np.roll(at, -1, axis=1)
        step = np.stack(snapped(after[..., 0] - at[..., 0], after[..., 1] - at[..., 1], rotation), 2) * (length / 2)[..., None]
        mid = (at + after) / 2
        total = np.where(pulls[..., None], mid - step, 0) + np.roll(np.where(pulls[..., None], mid + step, 0), 1, axis=1)
        at = np.where(n > 0, total / np.maximum(n, 1) * (1 - anchor) + home * anchor, at)
    return at


def _settled_batch(ring: pa.Array, sizes: np.ndarray, idx: pa.Array, xy: np.ndarray, rotation: float, iterations: int, anchor: float) -> pa.RecordBatch:
    """Rings of these sizes, one after the other in xy, after relaxation: ring, p (array of (idx, x, y))."""
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):  # rings of one size move together
        at = starts[sizes == size, None] + np.arange(size)
        xy[at] = _settled(xy[at], rotation, iterations, anchor)
    moved = pa.StructArray.from_arrays([idx, *xy.T.copy()], names=["idx", "x", "y"])
    return pa.RecordBatch.from_arrays([ring, relisted(sizes, moved, pa.list_(moved.type))], names=["ring", "p"])


def ring_relax(rings: DataFrame, rotation: float, iterations: int = 60, anchor: float = 0.12) -> DataFrame:
    """Open outlines (ring, idx, x, y) of four vertices or more after the same relaxation, each by itself; others are unchanged.

    An outline is one row of its vertices, so no round needs an exchange.
    """

    def run(batches):
        for batch in batches:
            _, sizes, points = listed(batch.column("p"))
            xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in "xy"], 1)
            yield _settled_batch(batch.column("ring"), sizes, points.field("idx"), xy, rotation, iterations, anchor)

    packed = _packed(rings.select("ring", "idx", "x", "y"), "ring", "idx")
    return packed.mapInArrow(run, packed.schema).select("ring", F.explode("p").alias("p")).select("ring", "p.*")


def _parted(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Lines of these sizes, one after the other, as densify() parts them, without their last vertices: places, and how many each line has now."""
    ends = np.cumsum(sizes)
    inner = np.ones(len(x), bool)
    inner[ends[sizes > 0] - 1] = False
    k = np.flatnonzero(inner)
    dx, dy = x[k + 1] - x[k], y[k + 1] - y[k]
    length = np.hypot(dx, dy)
    steps = np.where(length > most, np.floor(length / most) + 1, 1).astype(np.int64)
    at = np.repeat(np.arange(len(k)), steps)
    t = (np.arange(len(at)) - (np.cumsum(steps) - steps)[at]) / steps[at]
    all_steps = np.zeros(len(x) + 1, np.int64)
    all_steps[k + 1] = steps
    upto = np.cumsum(all_steps)
    return np.stack([x[k][at] + dx[at] * t, y[k][at] + dy[at] * t], 1), upto[ends] - upto[ends - sizes]


def snap_rings(rings: DataFrame, rotation: float, tolerance: float | Column, most: float = 120.0, iterations: int = 60, anchor: float = 0.12) -> DataFrame:
    """Closed outlines (ring, idx, x, y) simplified, parted into edges of at most `most`, and relaxed: ring, idx, x, y, open.

    `tolerance` may be a column of the ring's area. All is done in one row a ring, after one exchange.
    """
    packed = _packed(rings.select("ring", F.col("idx").alias("seq"), "x", "y"), "ring", "seq")
    if isinstance(tolerance, Column):
        turn = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        packed = packed.withColumn("area", F.abs(F.aggregate(turn, F.lit(0.0), lambda k, v: k + v)) / 2).withColumn("tolerance", tolerance).drop("area")
    else:
        packed = packed.withColumn("tolerance", F.lit(float(tolerance)))

    def run(batches):
        for batch in _thin_batches(batches):
            _, sizes, points = listed(batch.column("p"))
            xy, sizes = _parted(*(points.field(c).to_numpy(zero_copy_only=False) for c in "xy"), sizes, most)
            idx = np.arange(len(xy)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield _settled_batch(batch.column("ring"), sizes, pa.array(idx, pa.int32()), xy, rotation, iterations, anchor)

    kind = packed.schema["ring"].dataType.simpleString()
    done = packed.mapInArrow(run, f"ring {kind}, p array<struct<idx:int,x:double,y:double>>")
    return done.select("ring", F.explode("p").alias("p")).select("ring", "p.*")


def densify(edges: DataFrame, most: float) -> DataFrame:
    """Points that part every segment longer than `most` into equal steps: key columns, step, x, y; segment ends are left to the next."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    steps = F.when(length > most, F.floor(length / most).cast("int") + 1).otherwise(1)
    rows = edges.withColumn("steps", steps).select("*", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)).alias("step"))
    t = F.col("step") / F.col("steps")
    return rows.withColumns({"x": F.col("ax") + (F.col("bx") - F.col("ax")) * t, "y": F.col("ay") + (F.col("by") - F.col("ay")) * t}).drop("ax", "ay", "bx", "by", "steps")


def _packed(vertices: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key with its vertices in order: key, p (array of (order..., x, y))."""
    return vertices.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, "x", "y"))).alias("p"))


def _even(off):
    """Distances to a billionth of a metre, of numpy or of a column: those that differ by the last bits of a number are equal."""
    return (np.floor if isinstance(off, np.ndarray) else F.floor)(off * 1e9 + 0.5) / 1e9


def listed(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Where each list begins among all their elements, how long it is, and these elements."""
    ends = column.offsets.to_numpy()
    return ends[:-1] - ends[0], np.diff(ends), column.flatten()


def relisted(sizes: np.ndarray, values: pa.Array, kind: pa.DataType) -> pa.ListArray:
    """Lists of these sizes, one after the other."""
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), values).cast(kind)


def _thinned(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Which points stay on the stretches from a to b. Of equally far ones, to a billionth of a metre, the first parts a stretch.

    All stretches are parted together, again and again, until none has a point farther off than its tolerance.
    """
    keep = np.zeros(len(x), bool)
    keep[a] = keep[b] = True
    while len(long := np.flatnonzero(b - a >= 2)):
        a, b, tolerance = a[long], b[long], tolerance[long]
        inner = b - a - 1
        begin = np.cumsum(inner) - inner
        of = np.repeat(np.arange(len(a)), inner)
        k = np.arange(len(of)) - begin[of] + a[of] + 1
        dx, dy, qx, qy = (x[b] - x[a])[of], (y[b] - y[a])[of], x[k] - x[a][of], y[k] - y[a][of]
        square = dx * dx + dy * dy
        t = np.where(square > 0, np.clip((qx * dx + qy * dy) / np.where(square > 0, square, 1), 0, 1), 0)
        off = _even(np.sqrt((qx - t * dx) ** 2 + (qy - t * dy) ** 2))
        most, far = np.maximum.reduceat(off, begin), np.empty(len(a), np.int64)
        at = np.flatnonzero(off == most[of])[::-1]
        far[of[at]] = k[at]  # the first of equals is written last
        go = most > tolerance
        far = far[go]
        keep[far] = True
        a, b, tolerance = np.concatenate([a[go], far]), np.concatenate([far, b[go]]), np.tile(tolerance[go], 2)
    return keep


def _thin_batches(batches):
    """Batches of lines (p, tolerance) with the points of p that stay."""
    for batch in batches:
        starts, sizes, points = listed(batch.column("p"))
        x, y = (points.field(c).to_numpy(zero_copy_only=False) for c in "xy")
        some = sizes > 0
        keep = _thinned(x, y, starts[some], (starts + sizes - 1)[some], batch.column("tolerance").to_numpy(zero_copy_only=False)[some])
        left = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.concatenate([starts, [len(keep)]])])
        p = relisted(left, points.filter(pa.array(keep)), batch.column("p").type)
        yield batch.set_column(batch.schema.get_field_index("p"), batch.schema.field("p"), p)


#: Vertices of a stretch that one task simplifies.
STRETCH = 20_000


def line_simplify(vertices: DataFrame, tolerance: float, key: str = "road_id", stretch: int = STRETCH) -> DataFrame:
    """Each line with the vertices that keep it within the tolerance (Douglas-Peucker); of equally far ones, to a billionth of a metre, the first: key, seq, x, y.

    seq must tell a line's vertices apart. A line may have any number of vertices: as long as a stretch has more than `stretch`, its
    farthest vertex is found by an aggregate and parts it, or ends it if it is near enough; the rest is one row a stretch.
    """
    v = vertices.select(key, "seq", "x", "y")
    end = lambda f: f(F.struct("seq", "x", "y"))
    whole = v.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > stretch)
    small, kept, none = v.withColumn("from", F.lit(0)), [], whole.isEmpty()
    if not none:
        whole = v.groupBy(key).agg(end(F.min).alias("a"), end(F.max).alias("b"), F.count("*").alias("n"))
        span = v.join(whole, key)
        large, small = stored(span.where(F.col("n") > stretch), "spans"), span.where(F.col("n") <= stretch)
        while not large.isEmpty():
            fx, fy = G.segment_foot(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
            off = _even(F.hypot(F.col("x") - fx, F.col("y") - fy))
            inner = large.where((F.col("seq") > F.col("a.seq")) & (F.col("seq") < F.col("b.seq")))
            far = inner.groupBy(key, F.col("a.seq").alias("from")).agg(F.max(F.struct(off.alias("off"), (-F.col("seq")).alias("s"), "x", "y")).alias("f"))
            far = far.select(key, "from", F.when(F.col("f.off") > tolerance, F.struct((-F.col("f.s")).alias("seq"), "f.x", "f.y")).alias("k"))
            told = large.withColumn("from", F.col("a.seq")).join(far, [key, "from"])
            kept.append(told.where("k IS NULL AND (seq = a.seq OR seq = b.seq)").select(key, "seq", "x", "y"))  # near enough: only its ends
            sides = F.array_compact(F.array(F.when(F.col("seq") <= F.col("k.seq"), F.struct("a", F.col("k").alias("b"))), F.when(F.col("seq") >= F.col("k.seq"), F.struct(F.col("k").alias("a"), "b"))))
            parts = told.where("k IS NOT NULL").select(key, "seq", "x", "y", F.explode(sides).alias("s")).select(key, "seq", "x", "y", "s.a", "s.b")
            sizes = parts.groupBy(key, F.col("a.seq").alias("from")).agg(F.count("*").alias("n"))
            parts = stored(parts.withColumn("from", F.col("a.seq")).join(sizes, [key, "from"]).select(large.columns), "spans")
            small = small.unionByName(parts.where(F.col("n") <= stretch))
            large = parts.where(F.col("n") > stretch)

    packed = small.groupBy(key, "from" if none else F.col("a.seq").alias("from")).agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p")).withColumn("tolerance", F.lit(float(tolerance)))
    thin = packed.mapInArrow(_thin_batches, packed.schema).select(key, F.explode("p").alias("p")).select(key, "p.*")
    for df in kept:
        thin = thin.unionByName(df)
    return thin.dropDuplicates([key, "seq"]) if kept else thin  # stretches share their ends


def _chained(ends: list, sizes: list) -> list:
    """Closed rings from ways (their ends, and how many vertices each has), in the order of the ways: ring, way's number here, back, at, first.

    The first way that is left begins a ring; the first of those left that continues it, at its end or else its beginning, either way
    round, goes on, until it closes; a chain that nothing continues is dropped. `at` is the place of the way's beginning on the ring, `back`
    says that it runs the other way. Ways are found by their ends, so this is linear but for ways that meet in one place.
    """
    by_end: dict[tuple, list[int]] = {}
    for k in range(len(ends) - 1, -1, -1):  # the first ones last, so they are taken from the end
        for e in set(ends[k]):
            by_end.setdefault(e, []).append(k)
    left = [True] * len(ends)

    def first_at(place: tuple) -> int | None:
        waiting = by_end.get(place, [])
        while waiting and not left[waiting[-1]]:
            waiting.pop()
        return waiting[-1] if waiting else None

    out, rings = [], 0
    for begin in range(len(ends)):
        if not left[begin]:
            continue
        left[begin] = False
        head, tail = ends[begin]
        ring = deque([(begin, False)])
        while head != tail:
            found = [k for k in (first_at(tail), first_at(head)) if k is not None]
            if not found:
                break
            k = min(found)
            left[k] = False
            (a, b) = ends[k]
            if a == tail or b == tail:
                ring.append((k, a != tail))
                tail = b if a == tail else a
            else:
                ring.appendleft((k, b != head))
                head = a if b == head else b
        if head == tail and sum(sizes[k] - 1 for k, _ in ring) >= 3:
            at = 0
            for i, (k, back) in enumerate(ring):
                out.append((rings, k, back, at, i == 0))
                at += sizes[k] - 1
            rings += 1
    return out


def _joined(ways: list) -> list:
    """The same from rows of ways (way_no, a, b, n): ring_id, way_no, back, at, first."""
    told = _chained([((w["a"]["x"], w["a"]["y"]), (w["b"]["x"], w["b"]["y"])) for w in ways], [w["n"] for w in ways])
    return [{"ring_id": ring, "way_no": ways[k]["way_no"], "back": back, "at": at, "first": first} for ring, k, back, at, first in told]


def ring_assembly(ways: DataFrame) -> DataFrame:
    """Join the member ways (relation_id, way_no, seq, x, y) of each relation end to end into closed rings of four vertices or more:
    relation_id, ring_id, seq, x, y.

    Only the ends of a relation's ways are put in order in one row; the vertices, of whatever number, find their place by a join.
    Ways of a single vertex go. Rings are numbered in the order in which they close.
    """
    w = Window.partitionBy("relation_id", "way_no").orderBy("seq")
    v = ways.select("relation_id", "way_no", "x", "y", (F.row_number().over(w) - 1).alias("idx"))
    place = F.struct("x", "y")
    ends = ways.groupBy("relation_id", "way_no").agg(F.min_by(place, "seq").alias("a"), F.max_by(place, "seq").alias("b"), F.count("*").alias("n")).where("n > 1")

    def run(batches):
        for batch in batches:
            starts, sizes, ways = listed(batch.column("p"))
            at = {e: list(zip(*(ways.field(e).field(c).to_pylist() for c in "xy"), strict=True)) for e in "ab"}
            ends, n = list(zip(at["a"], at["b"], strict=True)), ways.field("n").to_pylist()
            rows, which = [], []
            for r, (i, j) in enumerate(zip(starts.tolist(), (starts + sizes).tolist(), strict=True)):
                got = _chained(ends[i:j], n[i:j])
                rows += [(ring, i + k, *rest) for ring, k, *rest in got]
                which += [r] * len(got)
            ring, k, back, begin, first = zip(*rows, strict=True) if rows else [()] * 5
            k = pa.array(k, pa.int64())
            made = [batch.column("relation_id").take(pa.array(which, pa.int64())), pa.array(ring, pa.int64()), ways.field("way_no").take(k), ways.field("n").take(k), pa.array(back, pa.bool_()), pa.array(begin, pa.int64()), pa.array(first, pa.bool_())]
            yield pa.RecordBatch.from_arrays(made, names=["relation_id", "ring_id", "way_no", "n", "back", "at", "first"])

    packed = ends.groupBy("relation_id").agg(F.sort_array(F.collect_list(F.struct("way_no", "a", "b", "n"))).alias("p"))
    kinds = [ways.schema[c].dataType.simpleString() for c in ("relation_id", "way_no")]
    told = packed.mapInArrow(run, f"relation_id {kinds[0]}, ring_id long, way_no {kinds[1]}, n long, back boolean, at long, first boolean")
    along = F.when(F.col("back"), F.col("n") - 1 - F.col("idx")).otherwise(F.col("idx"))
    laid = v.join(told, ["relation_id", "way_no"]).withColumn("along", along).where("first OR along > 0")
    return laid.select("relation_id", "ring_id", (F.col("at") + F.col("along")).cast("long").alias("seq"), "x", "y")


def draw_classes(roads: DataFrame) -> DataFrame:
    """roads (road_id, imp, bridge, tunnel) -> the bands each is drawn in: pavement, carriageway (major up to rank 4), bridge."""
    open_air = ~F.col("tunnel") & ~F.col("bridge")
    return roads.select("road_id", (open_air & (F.col("imp") <= 6)).alias("pavement"), F.when(open_air, F.when(F.col("imp") <= 4, "major").otherwise("minor")).alias("carriageway"), (F.col("bridge") & ~F.col("tunnel")).alias("on_bridge"))


def widest_first(roads: DataFrame) -> DataFrame:
    """All roads in drawing order, the widest first: road_id, place."""
    return prefix_sums(roads.select("road_id", "width_m"), [F.desc("width_m"), F.col("road_id")]).select("road_id", F.col("place").cast("long"))


def bridge_order(segments: DataFrame, camera: G.Camera) -> DataFrame:
    """Bridges (road_id, ax, ay, bx, by) from back to front, by the height on the canvas of their lines' centroids: road_id, place."""
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    mean = lambda c: F.sum(length * (F.col(f"a{c}") + F.col(f"b{c}")) / 2) / F.sum(length)
    mid = segments.where(length > 0).groupBy("road_id").agg(mean("x").alias("x"), mean("y").alias("y"))
    placed = mid.select("road_id", F.round(camera.ground(F.col("x"), F.col("y"))[1], 6).alias("sy"))
    return prefix_sums(placed, [F.col("sy"), F.col("road_id")]).select("road_id", F.col("place").cast("long"))
