"""Planar arrangements: lines cut at their crossings, and the regions that they enclose.

Places are whole numbers of a grain, so a node is its two numbers and all tests are exact. Segments meet on adaptive cells; each is
cut where it crosses or touches another, and what was bent by rounding a crossing to the grain is tried again until nothing is. Each
piece then is two half-edges. At every node the half-edges are ordered by angle, which says how to go on to the next edge of the
region on the left; regions are the cycles. Blocks of the plane follow them on their own; only the ways of cycles through several
blocks are named together, by pointer doubling in as many turns as the logarithm of the most blocks that a cycle enters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.cells import fit, narrowed
from loomgrid.operators.spatial import point_in_polygon, shore_probes
from loomgrid.sources.tables import dropped, stored

_ENDS = ["ax", "ay", "bx", "by"]


def clipped(segments: DataFrame, frame: tuple[float, float, float, float], *keys: str) -> DataFrame:
    """segments (keys, ax, ay, bx, by) -> what of them is inside the frame (x0, y0, x1, y1): the same columns, and whether either end was cut.

    The part of a segment inside each side is a range of its parameter; what is left is their overlap. Single points go.
    """
    x0, y0, x1, y1 = map(float, frame)
    ax, ay, bx, by = map(F.col, _ENDS)
    dx, dy = bx - ax, by - ay
    low, high, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for step, room in ((-dx, ax - x0), (dx, x1 - ax), (-dy, ay - y0), (dy, y1 - ay)):
        t = room / F.when(step != 0, step)
        low.append(F.coalesce(F.when(step < 0, t), F.lit(0.0)))
        high.append(F.coalesce(F.when(step > 0, t), F.lit(1.0)))
        out = out | ((step == 0) & (room < 0))
    cut = segments.where(~out).withColumns({"_t0": F.greatest(*low), "_t1": F.least(*high)}).where("_t0 < _t1")
    at = lambda t: [F.when(t == 0, a).when(t == 1, b).otherwise(a + (b - a) * t) for a, b in ((ax, bx), (ay, by))]
    (px, py), (qx, qy) = at(F.col("_t0")), at(F.col("_t1"))
    return cut.select(*keys, px.alias("ax"), py.alias("ay"), qx.alias("bx"), qy.alias("by"), (F.col("_t0") > 0).alias("cut_a"), (F.col("_t1") < 1).alias("cut_b"))


def _sorted_ends(segments: DataFrame) -> DataFrame:
    """Distinct segments whose first end is the lesser, net: how many run that way less how many run back, and whether any is bent. Single points go."""
    a, b = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    pair = segments.select(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"), F.when(a < b, F.col("net")).otherwise(-F.col("net")).alias("net"), "bent").where("p <> q")
    return pair.groupBy(F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.col("q.x").alias("bx"), F.col("q.y").alias("by")).agg(F.sum("net").alias("net"), F.max("bent").alias("bent"))


def _cross(p: str, q: str, r: str) -> Column:
    """Twice the area of the triangle of three places, over 0 if it turns left."""
    return (F.col(q + "x") - F.col(p + "x")) * (F.col(r + "y") - F.col(p + "y")) - (F.col(q + "y") - F.col(p + "y")) * (F.col(r + "x") - F.col(p + "x"))


def _cuts(segments: DataFrame, cell: float, smallest: float) -> DataFrame:
    """sid, x, y: where segments (sid, bent, and ends in grains) are crossed or touched by others between their ends, if one of the two is bent."""
    middles = segments.select(((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
    cells = fit(middles, max(smallest, narrowed(segments, cell, 16)), smallest)
    at = ["lv", "ci", "cj"]
    placed = cells.of_segments(segments)
    other = placed.where("bent").select(*at, *[F.col(c).alias(f"o_{c}") for c in ["sid", *_ENDS]])
    pairs = placed.join(other, at).where("sid <> o_sid AND (sid < o_sid OR NOT bent) AND ax <= o_bx AND o_ax <= bx AND least(ay, by) <= greatest(o_ay, o_by) AND least(o_ay, o_by) <= greatest(ay, by)")
    sides = {"d1": _cross("a", "b", "o_a"), "d2": _cross("a", "b", "o_b"), "d3": _cross("o_a", "o_b", "a"), "d4": _cross("o_a", "o_b", "b")}
    pairs = pairs.withColumns(sides)
    t = F.col("d3") / (F.col("d3") - F.col("d4"))
    spot = [F.col(f"a{c}") + F.rint((F.col(f"b{c}") - F.col(f"a{c}")) * t).cast("long") for c in "xy"]
    through = (F.signum("d1") * F.signum("d2") < 0) & (F.signum("d3") * F.signum("d4") < 0)

    def on(side: str, sid: str, own: str, end: str) -> Column:
        """An end that lies on the segment, and not at its ends."""
        px, py = F.col(f"{end}x"), F.col(f"{end}y")
        a, b = (own + "a", own + "b")
        within = [p.between(F.least(F.col(a + c), F.col(b + c)), F.greatest(F.col(a + c), F.col(b + c))) for p, c in ((px, "x"), (py, "y"))]
        inner = ~((px == F.col(a + "x")) & (py == F.col(a + "y"))) & ~((px == F.col(b + "x")) & (py == F.col(b + "y")))
        return F.when((F.col(side) == 0) & within[0] & within[1] & inner, F.struct(F.col(sid).alias("sid"), px.alias("x"), py.alias("y")))

    found = [F.when(through, F.struct(F.col(s).alias("sid"), spot[0].alias("x"), spot[1].alias("y"))) for s in ("sid", "o_sid")]
    found += [on("d1", "sid", "", "o_a"), on("d2", "sid", "", "o_b"), on("d3", "o_sid", "o_", "a"), on("d4", "o_sid", "o_", "b")]
    return pairs.select(F.explode(F.array_compact(F.array(*found))).alias("c")).select("c.*").distinct()


def noded(segments: DataFrame, grain: float = 1e-3, cell: float = 500.0) -> DataFrame:
    """segments (ax, ay, bx, by) -> the same of pieces in whole grains that meet at their ends only; what lies on one another is one piece."""
    return counted_pieces(segments, grain, cell).select(*_ENDS)


def counted_pieces(segments: DataFrame, grain: float = 1e-3, cell: float = 500.0) -> DataFrame:
    """The pieces of noded(), and net.

    net is the number of segments that run along the piece less that of those that run against it. Segments may be some two million
    grains long. A crossing is rounded to the grain, which can make a new one, so pieces are cut until none is. All parts of a segment
    that a rounded crossing bends are tried again, and what they meet; parts that lie on their segment meet only where it was cut.
    """
    whole = segments.select(*[F.rint(F.col(c) / grain).cast("long").alias(c) for c in _ENDS], F.lit(1).cast("long").alias("net"), F.lit(True).alias("bent"))
    pieces = stored(_sorted_ends(whole), "pieces")
    while not pieces.where("bent").isEmpty():
        numbered = stored(pieces.withColumn("sid", F.monotonically_increasing_id()), "numbered")
        cuts = stored(_cuts(numbered, cell / grain, cell / grain / 256), "cuts")
        if cuts.isEmpty():
            dropped(numbered, cuts)
            return pieces.drop("bent")
        dropped(pieces)
        ends = numbered.select("sid", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("e")).select("sid", "e.*")
        touched = ends.join(cuts.select("sid").distinct(), "sid", "left_semi").unionByName(cuts).join(numbered.select("sid", *_ENDS, "net"), "sid")
        away = (F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay"))
        w = Window.partitionBy("sid")
        along = w.orderBy("away", "x", "y")
        off = touched.withColumns({"away": away, "bent": F.max(_cross("a", "b", "") != 0).over(w)})
        parts = off.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(along).alias("bx"), F.lead("y").over(along).alias("by"), "net", "bent").where("bx IS NOT NULL")
        rest = numbered.join(cuts.select("sid").distinct(), "sid", "left_anti").select(*_ENDS, "net", F.lit(False).alias("bent"))
        pieces = stored(_sorted_ends(rest.unionByName(parts)), "pieces")
        dropped(numbered, cuts)
    return pieces.drop("bent")


def _traced(rows: pa.Table) -> pa.Table:
    """The half-edges that come into the nodes of a block, and the cycles or ways that they make there.

    rows: the half-edges h that leave these nodes (ax, ay) for (bx, by), and whether the latter is in the block too (stays). Their twins
    come in, and go on along the half-edge that is next clockwise. A way that leaves the block is named by its first half-edge, way,
    whose row also has the half-edge that the way goes on to, ptr, and in cycle the least of its half-edges; for a cycle that does not leave
    the block way is null, and cycle its least half-edge in all rows.
    """
    ax, ay, bx, by, h = (rows[c].to_numpy() for c in ("ax", "ay", "bx", "by", "h"))
    stays, n = rows["stays"].to_numpy(zero_copy_only=False), len(rows)
    turned = np.lexsort((h, np.arctan2((by - ay).astype(float), (bx - ax).astype(float)), ay, ax))
    first = np.ones(n, bool)
    first[1:] = (ax[turned][1:] != ax[turned][:-1]) | (ay[turned][1:] != ay[turned][:-1])
    starts = np.flatnonzero(first)
    place = np.arange(n) - 1
    place[starts] = np.append(starts[1:], n) - 1
    goes = np.empty(n, np.int64)
    goes[turned] = turned[place]  # for the twin of each row's half-edge the row of that which it goes on to
    member = h ^ 1
    by_number = np.argsort(member)
    inner = stays[goes]
    begins = np.ones(n, bool)
    came = np.arange(n)  # the row that each comes from
    after = by_number[np.searchsorted(member, h[goes[inner]], sorter=by_number)]
    came[after], begins[after] = np.flatnonzero(inner), False
    least = member.copy()
    for _ in range(n.bit_length()):
        least, came = np.minimum(least, least[came]), came[came]
    open_ = begins[came]
    cycle, ptr = np.where(open_, -1, least), np.full(n, -1)
    ends = np.flatnonzero(~inner)
    ptr[came[ends]], cycle[came[ends]] = h[goes[ends]], least[ends]
    null = lambda v, at: pa.array(v, pa.int64(), mask=at)
    made = {"h": member, "twin": h, "cycle": null(cycle, cycle < 0), "way": null(member[came], ~open_), "ptr": null(ptr, ptr < 0)}
    return pa.table({k: pa.array(v, pa.int64()) for k, v in (made | {"ax": bx, "ay": by, "bx": ax, "by": ay}).items()})


#: Half-edges of a block, at most where they can be parted, but for tables of many more.
BLOCK = 50_000


def cycles(pieces: DataFrame, grain: float = 1e-3, cell: float = 500.0) -> DataFrame:
    """pieces (ax, ay, bx, by) -> h, twin, cycle, ax, ay, bx, by: both half-edges of each, with the name of the cycle that has its region on the left.

    The half-edges of a block's nodes are one task's; a node must not have a large share of all pieces.
    """
    one = stored(pieces.select(*_ENDS, (F.monotonically_increasing_id() * 2).alias("h")), "halves")
    size = cell / grain * 8
    blocks = fit(one.select(F.col("ax").alias("x"), F.col("ay").alias("y")), size, size / 4096, BLOCK // 2)
    name = F.struct("lv", "ci", "cj")
    placed = one
    for end in "ab":
        placed = blocks.of_points(placed, f"{end}x", f"{end}y").withColumn(f"{end}_block", name).drop("lv", "ci", "cj")
    way = lambda a, b, h: F.struct(*[F.col(f"{e}{c}").alias(f"{n}{c}") for n, e in (("a", a), ("b", b)) for c in "xy"], h.alias("h"), F.col(f"{a}_block").alias("block"))
    both = placed.select((F.col("a_block") == F.col("b_block")).alias("stays"), F.explode(F.array(way("a", "b", F.col("h")), way("b", "a", F.col("h") + 1))).alias("w")).select("w.*", "stays")
    kinds = "h long, twin long, cycle long, way long, ptr long, ax long, ay long, bx long, by long"
    halves = stored(both.groupBy("block").applyInArrow(_traced, kinds), "turns")
    dropped(one)
    step = stored(halves.where("ptr IS NOT NULL").select("h", "ptr", "cycle"), "steps")
    while not step.isEmpty():
        ahead = step.select(F.col("h").alias("ptr"), F.col("ptr").alias("far"), F.col("cycle").alias("there"))
        new = step.join(ahead, "ptr").select("h", F.col("far").alias("ptr"), F.least("cycle", "there").alias("cycle"), (F.col("there") < F.col("cycle")).alias("moved"))
        new = stored(new, "steps")
        dropped(step)
        step = new
        if new.where("moved").isEmpty():  # then each stretch's least name is that of its whole cycle
            break
    closed = halves.where("way IS NULL").select("h", "twin", "cycle", *_ENDS)
    return closed.unionByName(halves.where("way IS NOT NULL").drop("cycle").join(step.select(F.col("h").alias("way"), "cycle"), "way").select("h", "twin", "cycle", *_ENDS))


def regions(segments: DataFrame, grain: float = 1e-3, cell: float = 500.0) -> DataFrame:
    """segments (ax, ay, bx, by) -> r_id, ax, ay, bx, by: the edges of all bounded regions that they enclose, holes included, areas to the left.

    Edges with one region on both sides (loose ends, bridges) bound nothing. A cycle with nothing on its left but the outside is a
    hole of the smallest region around it, which holds the place just left of its leftmost node.
    """
    return _enclosed(noded(segments, grain, cell), grain, cell)


def _enclosed(pieces: DataFrame, grain: float, cell: float) -> DataFrame:
    """regions() of pieces in whole grains that meet at their ends only."""
    named = cycles(pieces, grain, cell)
    halves = stored(named, "cycles")
    dropped(named)
    x0, y0 = halves.agg(F.min("ax"), F.min("ay")).first()
    if x0 is None:
        return pieces.limit(0).select(F.lit(0).cast("long").alias("r_id"), *[F.col(c).cast("double").alias(c) for c in _ENDS])
    local = {c: (F.col(c) - F.lit(x0 if c[1] == "x" else y0)).cast("double") * grain for c in _ENDS}
    # the two half-edges of a piece have numbers that differ in their last bit
    side = F.struct("cycle", *_ENDS)
    pair = halves.groupBy(F.shiftright("h", 1).alias("piece")).agg(F.min_by(side, "h").alias("one"), F.max_by(side, "h").alias("other")).where("one.cycle <> other.cycle")
    bounding = stored(pair.select(F.explode(F.array("one", "other")).alias("s")).select("s.*").select("cycle", *[c.alias(n) for n, c in local.items()]), "bounding")
    area = F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2
    sized = stored(bounding.groupBy("cycle").agg(area.alias("area"), F.min(F.struct("ax", "ay")).alias("left")), "areas")
    inner = sized.where("area > 0")
    faces = bounding.join(inner.select("cycle"), "cycle", "left_semi").withColumnRenamed("cycle", "r_id")
    probes = sized.where("area < 0").select(F.col("cycle").alias("p_id"), (F.col("left.ax") - grain / 2).alias("x"), F.col("left.ay").alias("y"))
    around = point_in_polygon(probes, faces, cell).join(inner.select(F.col("cycle").alias("r_id"), "area"), "r_id")
    home = around.groupBy("p_id").agg(F.min_by("r_id", F.struct("area", "r_id")).alias("r_id"))
    holes = bounding.join(home, F.col("cycle") == F.col("p_id")).select("r_id", *_ENDS)
    whole = faces.select("r_id", *_ENDS).unionByName(holes)
    return whole.select("r_id", *[(F.col(c) + F.lit((x0 if c[1] == "x" else y0) * grain)).alias(c) for c in _ENDS])


def left_sided(edges: DataFrame) -> DataFrame:
    """edges (r_id, ax, ay, bx, by) of simple rings, one a region -> the same edges run so that the area is on their left."""
    low = edges.groupBy("r_id").agg(F.min("ax").alias("x0"), F.min("ay").alias("y0"))
    turn = (F.col("ax") - F.col("x0")) * (F.col("by") - F.col("y0")) - (F.col("bx") - F.col("x0")) * (F.col("ay") - F.col("y0"))
    back = edges.join(low, "r_id").groupBy("r_id").agg((F.sum(turn) < 0).alias("back"))
    ends = [F.when(F.col("back"), F.col(o)).otherwise(F.col(c)).alias(c) for c, o in zip(_ENDS, ["bx", "by", "ax", "ay"], strict=True)]
    return edges.join(back, "r_id").select("r_id", *ends)


def outer_edges(areas: DataFrame, grain: float = 1e-3, cell: float = 500.0) -> DataFrame:
    """areas (r_id, ax, ay, bx, by), area on the left -> ax, ay, bx, by in whole grains: the edges of their union, area on the left.

    Edges of touching areas run both ways and cancel. Along any other piece one side has more areas than the other; the piece is on
    the outside if the side with fewer has none, which a point just beside its middle tells. So areas may also overlap or repeat.
    """
    pieces = counted_pieces(areas, grain, cell).where("net <> 0")
    swap = F.col("net") < 0
    run = pieces.select(*[F.when(swap, F.col(o)).otherwise(F.col(c)).alias(c) for c, o in zip(_ENDS, ["bx", "by", "ax", "ay"], strict=True)])
    run = stored(run.withColumn("p_id", F.monotonically_increasing_id()), "outer")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    size = F.sqrt((dx * dx + dy * dy).cast("double"))
    probes = run.select("p_id", ((F.col("ax") + F.col("bx")) / 2 + dy / size / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2 - dx / size / 2).alias("y"))
    whole = areas.select("r_id", *[F.rint(F.col(c) / grain).alias(c) for c in _ENDS])
    covered = point_in_polygon(probes, whole, cell / grain).select("p_id").distinct()
    return run.join(covered, "p_id", "left_anti").select(*_ENDS)


def dissolved(areas: DataFrame, grain: float = 1e-3, cell: float = 500.0) -> DataFrame:
    """areas (r_id, ax, ay, bx, by), area on the left -> r_id, ax, ay, bx, by: the edges of the areas that they make together.

    Touching, overlapping and repeated areas become one; areas that share a corner only stay apart. Holes that areas leave between
    them are holes of what is around them. Names are new. Each area is taken even-odd, so it may have holes of its own, with the
    area on the left there too (see left_sided() for rings of one direction). No areas make no edges.
    """
    outer = stored(outer_edges(areas, grain, cell), "union")
    lesser = F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")) < F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))
    pieces = outer.select(*[F.when(lesser, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in zip(_ENDS, ["bx", "by", "ax", "ay"], strict=True)])
    faces = stored(_enclosed(pieces, grain, cell), "faces")
    # a face is part of the union if it is on the left of its edges there, and a gap if it is on their right
    whole = [F.rint(F.col(c) / grain).cast("long").alias(c) for c in _ENDS]
    ours = faces.select("r_id", *whole).join(outer, _ENDS, "left_semi").select("r_id").distinct()
    return faces.join(ours, "r_id", "left_semi")


def _beyond(axis: str, at: float, above: bool):
    """A half-plane of rings: the part of a ring of points (x, y) on one side of a line parallel to an axis."""
    other = "y" if axis == "x" else "x"

    def cut(ring: Column) -> Column:
        room = lambda p: p[axis] - F.lit(at) if above else F.lit(at) - p[axis]

        def step(p: Column, i: Column) -> Column:
            before = F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i))
            # taken from the lesser end, so that a side shared by two rings is cut at one place
            a, b = F.least(before, p), F.greatest(before, p)
            met = a[other] + (b[other] - a[other]) * (F.lit(at) - a[axis]) / (b[axis] - a[axis])
            spot = F.struct(F.lit(at).alias("x"), met.alias("y")) if axis == "x" else F.struct(met.alias("x"), F.lit(at).alias("y"))
            crossed = F.when(room(before) * room(p) < 0, spot)
            return F.array_compact(F.array(crossed, F.when(room(p) >= 0, p)))

        return F.flatten(F.transform(ring, step))

    return cut


def clipped_rings(rings: DataFrame, frame: tuple[float, float, float, float]) -> DataFrame:
    """rings with ring, an array of points (x, y), open or closed -> the same with what of each is inside the frame (x0, y0, x1, y1), open.

    The ring is cut by four half-planes in turn, within its own row. A ring that leaves the frame several times stays one ring that runs
    along the frame between its parts, as its area and its even-odd inside need. Rings of which no area is left go, and so do null ones.
    """
    x0, y0, x1, y1 = map(float, frame)
    # a ring is bound before a lambda reads it again, and chosen in the array that is exploded: as a column of its own, each reading would
    # compute it anew in every step
    bound = lambda ring, f: F.transform(F.array(ring), f)[0]
    ring = F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    for axis, at, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        ring = bound(ring, _beyond(axis, at, above))

    def steps(r: Column) -> Column:  # points that repeat the one before them say nothing
        return F.filter(r, lambda p, i: (F.size(r) == 1) | (p != F.element_at(r, F.when(i == 0, F.size(r)).otherwise(i))))

    def broad(r: Column) -> Column:
        return (F.size(r) >= 3) & F.exists(r, lambda p: p["x"] != r[0]["x"]) & F.exists(r, lambda p: p["y"] != r[0]["y"])

    return rings.withColumn("ring", F.explode(F.filter(F.array(bound(ring, steps)), broad)))


def frame_sides(spark, frame: tuple[float, float, float, float]) -> DataFrame:
    x0, y0, x1, y1 = map(float, frame)
    return spark.createDataFrame([(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)], "ax double, ay double, bx double, by double")


def coast_regions(coast: DataFrame, frame: tuple[float, float, float, float], banks: DataFrame | None = None, grain: float = 1e-3, cell: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """coast (s_id, seq, ax, ay, bx, by) of shore lines, water on their right; banks (ax, ay, bx, by), the edges of known water.

    Returns the edges of all regions within the frame (r_id, ax, ay, bx, by), and the shore lines inside it in their parts (s_id,
    seq, ax, ay, bx, by), for a line that leaves the frame and comes back is two.
    """
    inside = clipped(coast, frame, "s_id", "seq")
    w = Window.partitionBy("s_id").orderBy("seq")
    starts = F.col("cut_a") | F.coalesce(F.lag("cut_b").over(w), F.lit(True)) | (F.col("seq") != F.lag("seq").over(w) + 1)
    parts = inside.withColumn("starts", starts).withColumn("part", F.sum(F.col("starts").cast("int")).over(w))
    lines = parts.select(F.struct("s_id", "part").alias("s_id"), "seq", *_ENDS)
    edges = inside.select(*_ENDS).unionByName(frame_sides(coast.sparkSession, frame))
    if banks is not None:
        edges = edges.unionByName(clipped(banks, frame).select(*_ENDS))
    return stored(regions(edges, grain, cell), "regions"), lines


def wet(edges: DataFrame, lines: DataFrame, cell: float = 500.0) -> DataFrame:
    """The regions of coast_regions() that hold a place just right of a shore line: r_id, ax, ay, bx, by."""
    probes = stored(shore_probes(lines), "probes")
    return edges.join(point_in_polygon(probes, edges, cell).select("r_id").distinct(), "r_id", "left_semi")


def water_regions(coast: DataFrame, frame: tuple[float, float, float, float], banks: DataFrame | None = None, grain: float = 1e-3, cell: float = 500.0) -> DataFrame:
    """The edges of the regions with water that shore lines and known banks enclose within the frame. See coast_regions()."""
    return wet(*coast_regions(coast, frame, banks, grain, cell), cell)


def region_measures(edges: DataFrame) -> DataFrame:
    """r_id, x0, y0, x1, y1, area of regions from their edges."""
    ax, ay, bx, by = map(F.col, _ENDS)
    mid = edges.groupBy("r_id").agg(F.min("ax").alias("x0"), F.min("ay").alias("y0"), F.max("ax").alias("x1"), F.max("ay").alias("y1"))
    area = F.sum((ax - F.col("x0")) * (by - F.col("y0")) - (bx - F.col("x0")) * (ay - F.col("y0"))) / 2
    return edges.join(mid, "r_id").groupBy("r_id", "x0", "y0", "x1", "y1").agg(area.alias("area"))
