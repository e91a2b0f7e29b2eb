"""Geometry invariants on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import geometry as G
from loomgrid.operators import buildings as B
from loomgrid.operators import spatial as X
from loomgrid.operators import streets as R


def grid(spark):
    rows = [(k * 10 + h, s, *((100.0 * s, 100.0 * k) if h else (100.0 * k, 100.0 * s))) for k in range(5) for h in (0, 1) for s in range(5)]
    return spark.createDataFrame(rows, "road_id long, seq long, x double, y double")


def test_a_perfect_grid(spark):
    b = R.segment_bearings(grid(spark))
    fit = R.grid_fit(b).first()
    assert fit.strength == pytest.approx(1) and min(fit.grid_angle, 90 - fit.grid_angle) == pytest.approx(0, abs=1e-6)
    e = R.rose_entropy(R.bearing_rose(b)).first()
    assert e.entropy == pytest.approx(2) and e.orderliness == pytest.approx(1)
    assert R.crisp_share(b, 0.0).first().share == pytest.approx(1)


def test_relaxation_straightens_streets(spark):
    bent = grid(spark).withColumns({"x": F.col("x") + 7 * F.sin(F.col("road_id") + F.col("seq")), "y": F.col("y") + 7 * F.cos(F.col("road_id") * 3 + F.col("seq"))})
    before = R.crisp_share(R.segment_bearings(bent), 0.0).first().share
    after = R.crisp_share(R.segment_bearings(R.relaxed_roads(bent, R.network_relax(bent, 0.0, iterations=12))), 0.0).first().share
    assert after > before + 0.2


def test_world_undoes_ground(spark):
    c = G.Camera((5.0, 6.0), 31.6, 0.7, 800, 600, 6.4, (0.0, 9.0))
    wx, wy = c.world(*c.ground(F.lit(12.5), F.lit(-3.25)))
    r = spark.range(1).select(wx.alias("x"), wy.alias("y")).first()
    assert (r.x, r.y) == (pytest.approx(12.5), pytest.approx(-3.25))


GRID = (53.5, -8.0, 0.99982, 600000.0, 750000.0)


def test_projection(spark):
    """A known place (the Spire in Dublin: 715830, 734697), the grid's origin, and the way back."""
    rows = [(53.349805, -6.260310), (53.5, -8.0), (51.4, -10.5), (55.4, -5.4)]
    t = spark.createDataFrame(rows, "lat double, lon double")
    x, y = G.transverse_mercator(F.col("lat"), F.col("lon"), *GRID)
    lat, lon = G.inverse_transverse_mercator(F.col("x"), F.col("y"), *GRID)
    out = t.select("lat", "lon", x.alias("x"), y.alias("y")).select("*", lat.alias("lat2"), lon.alias("lon2")).collect()
    assert (out[0].x, out[0].y) == (pytest.approx(715830, abs=8), pytest.approx(734697, abs=8))  # the place is given to a few metres
    assert (out[1].x, out[1].y) == (pytest.approx(600000, abs=1e-6), pytest.approx(750000, abs=1e-6))
    for r in out:
        assert (r.lat2, r.lon2) == (pytest.approx(r.lat, abs=1e-9), pytest.approx(r.lon, abs=1e-9))


def test_coverage(spark):
    corners = spark.createDataFrame([(600000.0, 750000.0), (600500.0, 750500.0)], "x double, y double")
    wide = spark.createDataFrame([(53.0, -8.5), (54.0, -7.5)], "lat double, lon double")
    assert not B.coverage_check(corners, wide, GRID).first().exceeds
    assert B.coverage_check(corners, wide.where("lat > 53.5"), GRID).first().exceeds
    assert B.coverage_check(corners, wide.limit(0), GRID).first().exceeds


def test_simplified_lines(spark):
    rnd = __import__("random").Random(3)
    rows = [(k, s, s * 10.0, rnd.uniform(-8, 8)) for k in range(6) for s in range(30)]
    rows += [(9, s, *p) for s, p in enumerate([(0, 0), (50, 1), (100, 0), (100, 100), (1, 100), (0, 0)])] + [(10, 0, 5.0, 5.0), (10, 1, 6.0, 6.0)]
    t = spark.createDataFrame([(k, s, float(x), float(y)) for k, s, x, y in rows], "road_id long, seq long, x double, y double")

    def off(p, a, b):
        (px, py), (ax, ay), (bx, by) = p, a, b
        long = (bx - ax) ** 2 + (by - ay) ** 2
        u = min(1, max(0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / long)) if long else 0
        return math.hypot(px - ax - u * (bx - ax), py - ay - u * (by - ay))

    def thin(p):
        if len(p) < 3:
            return p
        d = [off(q[1:], p[0][1:], p[-1][1:]) for q in p[1:-1]]
        k = d.index(max(d)) + 1
        return [p[0], p[-1]] if d[k - 1] <= 6.0 else thin(p[: k + 1])[:-1] + thin(p[k:])

    want = {(k, q[0]) for k in {r[0] for r in rows} for q in thin([r[1:] for r in rows if r[0] == k])}
    assert {(r.road_id, r.seq) for r in R.line_simplify(t, 6.0).collect()} == want


def test_all_layers(spark):
    roads = grid(spark).withColumn("y", F.col("y") + 3 * F.sin(F.col("x")))
    ring = rings(spark, 12.0).select(F.col("b_id").alias("ring"), F.col("seq").alias("idx"), (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y"))
    homes = rings(spark, 12.0).withColumns({"x": F.col("x") + 100, "y": F.col("y") + 95})
    out = X.schematize({"roads": roads, "rail": roads.where("road_id < 20"), "waterways": roads.limit(0)}, homes, {"water": ring, "green": ring, "urban": ring.limit(0)}, 0.0, 3.0)
    by = {r.layer: r.n for r in out.groupBy("layer").agg(F.count("*").alias("n")).collect()}
    assert set(by) == {"roads", "rail", "buildings", "water", "green"} and by["buildings"] == 5
    kept = out.where("layer = 'roads'").select(F.col("id").alias("road_id"), "seq", "x", "y")
    assert R.crisp_share(R.segment_bearings(kept), 0.0).first().share > 0.9
    # an outline of 800 by 400 metres, parted at 120 metres, ends along the clean directions
    water = R.segment_bearings(out.where("layer = 'water'").select(F.col("id").alias("road_id"), "seq", "x", "y"))
    before = R.segment_bearings(ring.select(F.col("ring").alias("road_id"), F.col("idx").alias("seq"), "x", "y"))
    assert water.count() > 12 and R.snap_cost(water, 0.0).first().cost < 0.9 * R.snap_cost(before, 0.0).first().cost
    home = B.longest_edge(B.edges(out.where("layer = 'buildings'").select(F.col("id").alias("b_id"), "seq", "x", "y"))).first()
    assert home.length == pytest.approx(8) and (home.bearing + 22.5) % 45 == pytest.approx(22.5)


def test_relaxed_networks_by_hand(spark):
    """Three roads that share nodes, against the rounds in plain Python; a road on its own stays where it pulls nothing."""
    paths = {1: [(0, 0), (97, 13), (205, 7)], 2: [(97, 13), (90, 120)], 3: [(205, 7), (97, 13), (0, 0)], 4: [(500, 500), (502, 501)]}
    rows = [(k, s, float(x), float(y)) for k, p in paths.items() for s, (x, y) in enumerate(p)]
    t = spark.createDataFrame(rows, "road_id long, seq long, x double, y double")
    for rounds in (1, 2, 7, 30):
        at = {p: p for q in paths.values() for p in q}
        for _ in range(rounds):
            pull = {}
            for q in paths.values():
                for a, b in zip(q, q[1:]):
                    half = math.dist(a, b) / 2
                    if half < 2:
                        continue
                    (ax, ay), (bx, by) = at[a], at[b]
                    turn = math.degrees(math.atan2(bx - ax, by - ay)) % 360
                    clean = math.radians((round(((turn - 10) % 360) / 45) * 45 + 10) % 360)
                    mx, my = (ax + bx) / 2, (ay + by) / 2
                    pull.setdefault(a, []).append((mx - math.sin(clean) * half, my - math.cos(clean) * half))
                    pull.setdefault(b, []).append((mx + math.sin(clean) * half, my + math.cos(clean) * half))
            at = {p: tuple(sum(v[c] for v in pull[p]) / len(pull[p]) * 0.96 + p[c] * 0.04 for c in (0, 1)) if p in pull else p for p in at}
        got = {(r.kx, r.ky): (r.x, r.y) for r in R.network_relax(t, 10.0, iterations=rounds).collect()}
        want = {(round(p[0] / 1.5), round(p[1] / 1.5)): v for p, v in at.items()}
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k] == (pytest.approx(v[0], abs=1e-6), pytest.approx(v[1], abs=1e-6))


def rings(spark, turn=20.0):
    t = math.radians(turn)
    corners = [(-4, -2), (4, -2), (4, 2), (-4, 2), (-4, -2)]
    return spark.createDataFrame([(1, s, 10 + x * math.cos(t) - y * math.sin(t), 20 + x * math.sin(t) + y * math.cos(t)) for s, (x, y) in enumerate(corners)], "b_id long, seq long, x double, y double")


def test_footprints(spark):
    m = B.polygon_measures(B.edges(rings(spark))).first()
    assert (m.area, m.cx, m.cy) == (pytest.approx(32), pytest.approx(10), pytest.approx(20))
    box = B.oriented_box(rings(spark)).first()
    assert (box.long_m, box.short_m) == (pytest.approx(8), pytest.approx(4))
    snapped = B.rigid_snap(rings(spark), 0.0)
    e = B.longest_edge(B.edges(snapped)).first()
    assert e.length == pytest.approx(8) and (e.bearing + 22.5) % 45 == pytest.approx(22.5)


def test_holes_are_outside(spark):
    def ring(k, lo, hi):
        c = [(lo, lo), (hi, lo), (hi, hi), (lo, hi), (lo, lo)]
        return [(1, *a, *b) for a, b in zip(c, c[1:])]

    edges = spark.createDataFrame(ring(0, 0.0, 900.0) + ring(1, 300.0, 600.0), "r_id long, ax double, ay double, bx double, by double")
    points = spark.createDataFrame([(1, 100.5, 100.5), (2, 450.5, 450.5), (3, 1000.0, 5.0)], "p_id long, x double, y double")
    assert [r.p_id for r in X.point_in_polygon(points, edges).collect()] == [1]


def test_empty_tables(spark):
    v = grid(spark).limit(0)
    assert R.grid_fit(R.segment_bearings(v)).count() == 0
    assert R.bearing_rose(R.segment_bearings(v)).agg(F.sum("length")).first()[0] == 0
    assert B.tagged_share(spark.createDataFrame([], "tagged boolean")).first().share == 0


def test_storeys(spark):
    rows = [("2;3", None), ("1,5", None), ("x", "32 m"), (None, "x"), ("0", None)]
    out = [(r.s.levels, r.s.tagged) for r in spark.createDataFrame(rows, "l string, h string").select(B.storeys(F.col("l"), F.col("h")).alias("s")).collect()]
    assert out == [(2.0, True), (1.5, True), (10.0, True), (2.0, False), (2.0, False)]
