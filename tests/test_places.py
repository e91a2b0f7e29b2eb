"""Cells, planar regions, relaxation in blocks, and orders of whole tables, against plain versions."""

import collections
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import cells as C
from loomgrid.operators import buildings, ordering, planar, relaxing, spatial, streets
from loomgrid.plans import map_queries
from loomgrid.plans.fixtures import with_views
from loomgrid.sources import tables

SEGMENT = "ax double, ay double, bx double, by double"


def inside(x, y, edges):
    """Even-odd by products only, exact for small whole numbers."""
    met = 0
    for ax, ay, bx, by in edges:
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        met += (ay > y) != (by > y) and (side > 0 if by > ay else side < 0)
    return met % 2 == 1


@pytest.mark.parametrize("lattice", [True, False])
def test_points_in_polygons_on_split_cells(spark, lattice):
    """Points and corners on edges and on the sides of cells, and a cluster that splits cells four times and more."""
    rnd = random.Random(lattice)
    spot = (lambda: (rnd.randrange(17) * 4.0, rnd.randrange(17) * 4.0)) if lattice else (lambda: (rnd.uniform(0, 64), rnd.uniform(0, 64)))
    polygons = {}
    for r in range(8):
        p = [spot() for _ in range(rnd.randint(3, 9))]
        polygons[r] = [(*p[i - 1], *p[i]) for i in range(len(p))]
    points = [(i, float(rnd.randrange(65)), float(rnd.randrange(65))) if lattice else (i, rnd.uniform(-5, 70), rnd.uniform(-5, 70)) for i in range(700)]
    points += [(10_000 + i, 20 + rnd.random(), 24 + rnd.random()) for i in range(700)] + [(20_000, None, 1.0)]
    edges = spark.createDataFrame([(r, *e) for r, es in polygons.items() for e in es], f"r_id long, {SEGMENT}")
    frame = spark.createDataFrame(points, "p_id long, x double, y double")
    assert len(C.fit(frame, 16.0, 16 / 256, 40).splits) >= 4
    got = [tuple(r) for r in spatial.point_in_polygon(frame, edges, 16.0, 40).select("p_id", "r_id").collect()]
    assert sorted(got) == sorted((i, r) for i, x, y in points if x is not None for r, es in polygons.items() if inside(x, y, es))


def test_no_cell_holds_most_points_of_a_cluster(spark):
    rnd = random.Random(3)
    points = [(rnd.gauss(500, 2), rnd.gauss(500, 2)) for _ in range(4000)] + [(rnd.uniform(0, 10_000), rnd.uniform(0, 10_000)) for _ in range(1000)]
    frame = spark.createDataFrame(points, "x double, y double")
    even = C.fit(frame, 500.0, 500 / 4096, 250).of_points(frame).groupBy("lv", "ci", "cj").count().agg(F.max("count")).first()[0]
    plain = C.Cells(500.0).of_points(frame).groupBy("ci", "cj").count().agg(F.max("count")).first()[0]
    assert even <= 250 < 900 < plain
    assert C.fit(frame.limit(0), 500.0, 2.0).splits == []


def test_a_long_segment_has_cells_along_it_only(spark):
    line = spark.createDataFrame([(0.0, 0.0, 7071.0, 7071.0)], SEGMENT)
    assert C.Cells(30.0).of_segments(line, 30.0).count() < 236 * 8  # its box has 55,000


def test_nearest_street_against_all_pairs(spark):
    rnd = random.Random(4)
    lines = [(rnd.uniform(0, 400), rnd.uniform(0, 400), rnd.uniform(0, 400), rnd.uniform(0, 400)) for _ in range(12)] + [(5.0, 5.0, 5.0, 5.0), (60.0, 0.0, 60.0, 90.0), (0.0, 90.0, 90.0, 90.0)]
    points = [(i, rnd.uniform(-40, 440), rnd.uniform(-40, 440)) for i in range(300)]
    got = {r.p_id: r.distance for r in spatial.nearest_street(spark.createDataFrame(points, "p_id long, x double, y double"), spark.createDataFrame(lines, SEGMENT), 30.0).collect()}
    want = {}
    for i, x, y in points:
        for ax, ay, bx, by in lines:
            dx, dy = bx - ax, by - ay
            t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            want[i] = min(want.get(i, 1e9), float(np.hypot(ax + t * dx - x, ay + t * dy - y)))
    assert got == {i: pytest.approx(d, abs=1e-9) for i, d in want.items() if 1e-6 <= d <= 30.0}


def flooded(walls, n):
    """Areas of the regions that whole axis-parallel walls enclose on n x n unit squares, the outside left out."""
    upright, flat = set(), set()
    for ax, ay, bx, by in walls:
        for k in range(min(ax, bx), max(ax, bx)):
            flat.add((k, ay))
        for k in range(min(ay, by), max(ay, by)):
            upright.add((ax, k))
    seen, areas = set(), []
    for start in [(-1, -1), *((i, j) for i in range(n) for j in range(n))]:
        if start in seen:
            continue
        todo, area = [start], 0
        seen.add(start)
        while todo:
            i, j = todo.pop()
            area += 1
            for i2, j2, wall in ((i + 1, j, (i + 1, j) in upright), (i - 1, j, (i, j) in upright), (i, j + 1, (i, j + 1) in flat), (i, j - 1, (i, j) in flat)):
                if not wall and -1 <= i2 <= n and -1 <= j2 <= n and (i2, j2) not in seen:
                    seen.add((i2, j2))
                    todo.append((i2, j2))
        areas.append(area)
    return sorted(areas[1:])


@pytest.mark.parametrize("seed", [1])
def test_regions_against_flooding(spark, seed):
    """Random walls that cross, touch, overlap, repeat, end loosely and lie in one another; turned, so that none is parallel to an axis."""
    rnd = random.Random(seed)
    walls = []
    for _ in range(22):
        x, y, d = rnd.randrange(14), rnd.randrange(14), rnd.randint(1, 9)
        walls.append((x, y, min(14, x + d), y) if rnd.random() < 0.5 else (x, y, x, min(14, y + d)))
    x, y = 15, 15  # a square in a square, joined to nothing
    for a, s in ((0, 5), (1, 3)):
        walls += [(x + a, y + a, x + a + s, y + a), (x + a + s, y + a, x + a + s, y + a + s), (x + a + s, y + a + s, x + a, y + a + s), (x + a, y + a + s, x + a, y + a)]
    walls.append(walls[0])
    turned = [(2 * ax - ay, ax + 2 * ay, 2 * bx - by, bx + 2 * by) for ax, ay, bx, by in walls]  # five times the area
    found = planar.regions(spark.createDataFrame([tuple(map(float, w)) for w in turned], SEGMENT), cell=16.0)
    got = planar.region_measures(found).collect()
    assert sorted(round(r.area / 5, 6) for r in got) == pytest.approx(flooded(walls, 22))


def test_regions_of_nothing(spark):
    assert planar.regions(spark.createDataFrame([], SEGMENT)).count() == 0


def test_crossings_that_round_to_new_ones(spark):
    """Pieces share no inner point after rounding to a coarse grain."""
    rnd = random.Random(9)
    lines = [tuple(rnd.uniform(0, 60) for _ in range(4)) for _ in range(25)]
    pieces = [tuple(r) for r in planar.noded(spark.createDataFrame(lines, SEGMENT), grain=1.0, cell=16.0).collect()]
    assert len(pieces) == len(set(pieces)) > 25
    cross = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    for i, (ax, ay, bx, by) in enumerate(pieces):
        a, b = (ax, ay), (bx, by)
        for cx, cy, dx, dy in pieces[:i]:
            c, d = (cx, cy), (dx, dy)
            s = [cross(a, b, c), cross(a, b, d), cross(c, d, a), cross(c, d, b)]
            assert not (s[0] * s[1] < 0 and s[2] * s[3] < 0)
            for side, p, (u, v) in ((s[0], c, (a, b)), (s[1], d, (a, b)), (s[2], a, (c, d)), (s[3], b, (c, d))):
                on = side == 0 and min(u[0], v[0]) <= p[0] <= max(u[0], v[0]) and min(u[1], v[1]) <= p[1] <= max(u[1], v[1])
                assert not on or p in (u, v)


def test_water_is_right_of_the_shore(spark):
    """A shore across the frame that leaves it and comes back; known water closes its loose end."""
    shore = [(1, 0, -5.0, 40.0), (1, 1, 30.0, 40.0), (1, 2, 30.0, 120.0), (1, 3, 60.0, 120.0), (1, 4, 60.0, 50.0), (1, 5, 85.0, 50.0)]
    coast = streets.segments(spark.createDataFrame(shore, "s_id long, seq long, x double, y double"), "s_id")
    banks = spark.createDataFrame([(80.0, -10.0, 80.0, 60.0), (80.0, 60.0, 110.0, 60.0), (110.0, 60.0, 110.0, -10.0), (110.0, -10.0, 80.0, -10.0)], SEGMENT)
    frame = (0.0, 0.0, 100.0, 100.0)
    edges, lines = planar.coast_regions(coast, frame, banks)
    assert lines.select("s_id").distinct().count() == 2
    areas = lambda df: sorted(round(r.area, 3) for r in planar.region_measures(df).collect())
    # the corner behind the bank; the land left of the rise and of the fall; what is below and between
    assert areas(edges) == [1200, 1800, 1800, 5200]
    water = planar.wet(edges, lines).cache()
    assert areas(water) == [1200, 5200]
    home = spark.createDataFrame([(i, 10.0 + i, 5.0) for i in range(13)], "p_id long, x double, y double")
    kept = spatial.region_reject(water.select("r_id").distinct(), edges, home)
    assert areas(water.join(kept, "r_id", "left_semi")) == [1200]


def test_clipping(spark):
    rows = [(0, -5.0, 5.0, 15.0, 5.0), (1, 2.0, 2.0, 3.0, 3.0), (2, -5.0, -5.0, -1.0, 20.0), (3, 0.0, 0.0, 10.0, 0.0), (4, -2.0, 2.0, 2.0, -2.0), (5, 5.0, 12.0, 5.0, -3.0), (6, 11.0, 0.0, 11.0, 9.0), (7, -1.0, 0.0, 4.0, 10.0)]
    got = {r.k: (r.ax, r.ay, r.bx, r.by, r.cut_a, r.cut_b) for r in planar.clipped(spark.createDataFrame(rows, f"k long, {SEGMENT}"), (0, 0, 10, 10), "k").collect()}
    assert got == {0: (0.0, 5.0, 10.0, 5.0, True, True), 1: (2.0, 2.0, 3.0, 3.0, False, False), 3: (0.0, 0.0, 10.0, 0.0, False, False), 5: (5.0, 10.0, 5.0, 0.0, True, True), 7: (0.0, 2.0, 4.0, 10.0, True, False)}


@pytest.mark.parametrize(("hops", "block"), [(3, 25), (8, 60)])
def test_relaxation_in_blocks_is_that_of_one_block(spark, hops, block):
    rnd = random.Random(hops)
    rows = []
    for r in range(40):
        x, y = rnd.uniform(0, 300), rnd.uniform(0, 300)
        for q in range(rnd.randint(2, 20)):
            rows.append((r, q, x, y))
            x, y = x + rnd.uniform(-30, 30), y + rnd.uniform(-30, 30)
    v = spark.createDataFrame(rows, "road_id long, seq long, x double, y double")
    nodes, links = streets.node_first_seen(v).cache(), streets.network_links(v).cache()
    told = [{(r.kx, r.ky): (r.x, r.y) for r in relaxing.relax(nodes, links, 31.61, 17, 0.04, 4.0, **how).collect()} for how in ({}, {"hops": hops, "block_nodes": block})]
    assert told[0].keys() == told[1].keys() and len(told[0]) == nodes.count()
    assert max(np.hypot(told[0][k][0] - told[1][k][0], told[0][k][1] - told[1][k][1]) for k in told[0]) < 1e-9
    assert relaxing.relax(nodes.limit(0), links, 31.61, 5, 0.04).count() == 0


def test_surroundings_against_breadth_first(spark):
    rnd = random.Random(8)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)]
    block = {k: k % 7 for k in range(60)}
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = set()
    for g in range(7):
        at = {k for k in block if block[k] == g}
        reached = set(at)
        for _ in range(3):
            at = {v for u in at for v in near[u]} - reached
            reached |= at
        want |= {(g, k) for k in reached if block[k] != g}
    links = spark.createDataFrame([(u, v, block[u], block[v]) for a, b in pairs for u, v in ((a, b), (b, a))], "own long, other long, block long, other_block long")
    assert {tuple(r) for r in relaxing.surroundings(links, 3).collect()} == want


def test_prefix_sums_part_ties(spark):
    rows = [(k, 5.0 if k % 3 else float(k % 11)) for k in range(400)]
    got = sorted((r.place, r.k, r.running) for r in ordering.prefix_sums(spark.createDataFrame(rows, "k long, v double").repartition(5), [F.desc("v"), F.col("k")], "v", part_rows=23).collect())
    total, want = 0.0, []
    for place, (k, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += v
        want.append((place, k, total))
    assert got == want
    assert ordering.prefix_sums(spark.createDataFrame([], "k long, v double"), [F.col("k")], "v").count() == 0


def test_long_lines_are_simplified_in_stretches(spark):
    rnd = random.Random(12)
    rows = []
    for line, n in ((1, 400), (2, 90), (3, 2), (4, 1), (5, 300), (6, 120)):
        x = y = 0.0
        for s in range(n):
            rows.append((line, s, x, y))
            x, y = (x + rnd.uniform(-3, 5), y + rnd.uniform(-4, 4)) if line != 5 else (x + 1.0, 0.0)
        if line == 6:  # closed: both ends are one place
            rows.append((line, n, 0.0, 0.0))
    v = spark.createDataFrame(rows, "road_id long, seq long, x double, y double").repartition(3)
    told = [sorted(tuple(r) for r in streets.line_simplify(v, 4.0, stretch=n).collect()) for n in (20_000, 25)]
    assert told[0] == told[1] and 20 < len(told[0]) < 500
    assert [r[1] for r in told[0] if r[0] == 5] == [0, 299]


def test_smallest_boxes_against_all_pairs_of_points(spark, monkeypatch):
    """Along every line through two points that has all others on one side; rings in one part and in many."""
    rng = np.random.default_rng(5)
    rings = {k: (rng.integers(0, 8, (rng.integers(2, 40), 2)).astype(float) if k % 2 else rng.normal(size=(30, 2)) * [5, 1]) for k in range(30)}
    rings[99] = np.asarray([[3.0, 3.0], [3.0, 3.0]])
    want = {}
    for k, p in rings.items():
        for i in range(len(p)):
            for j in range(len(p)):
                size = np.hypot(*(p[j] - p[i]))
                if size > 1e-9:
                    u = (p[j] - p[i]) / size
                    along, across = p @ u, p @ np.asarray([-u[1], u[0]])
                    if (across - across[i] >= -1e-9).all():
                        want[k] = min(want.get(k, 1e18), (along.max() - along.min()) * (across.max() - across.min()))
    v = spark.createDataFrame([(k, s, float(x), float(y)) for k, p in rings.items() for s, (x, y) in enumerate(p)], "b_id long, seq long, x double, y double")
    for part in (50_000, 7):
        monkeypatch.setattr(buildings, "HULL_POINTS", part)
        got = {r.b_id: r.box_area for r in buildings.oriented_box(v).collect()}
        assert got == {k: pytest.approx(a, abs=1e-5) for k, a in want.items()}


def test_the_hull_of_a_round_ring_of_many_vertices():
    turn = np.linspace(0, 2 * np.pi, 100_000, endpoint=False)
    box = buildings.smallest_box(buildings.hull(np.stack([5 * np.cos(turn), 2 * np.sin(turn)], 1)))
    assert (box[3] - box[2]) * (box[5] - box[4]) == pytest.approx(40, abs=1e-5)


def plain_rings(ways):
    """Rings by a search through all ways that are left at every step."""
    left, out = [w for w in ways if len(w) > 1], []
    while left:
        ring = left.pop(0)
        while ring[0] != ring[-1]:
            for k, way in enumerate(left):
                if ring[-1] in (way[0], way[-1]):
                    ring = ring + (way if way[0] == ring[-1] else way[::-1])[1:]
                elif ring[0] in (way[0], way[-1]):
                    ring = (way if way[-1] == ring[0] else way[::-1])[:-1] + ring
                else:
                    continue
                left.pop(k)
                break
            else:
                break
        if len(ring) >= 4 and ring[0] == ring[-1]:
            out.append(ring)
    return out


def test_rings_with_junctions_and_open_chains(spark):
    rnd = random.Random(14)
    relations, rows = {}, []
    for r in range(80):
        spot = lambda: (float(rnd.randrange(3)), float(rnd.randrange(2)))
        relations[r] = [[spot() for _ in range(rnd.randint(1, 4))] for _ in range(rnd.randint(1, 14))]
        rows += [(r, k, s * 5, x, y) for k, way in enumerate(relations[r]) for s, (x, y) in enumerate(way)]
    got = collections.defaultdict(list)
    for q in streets.ring_assembly(spark.createDataFrame(rows, "relation_id long, way_no long, seq long, x double, y double").repartition(3)).orderBy("relation_id", "ring_id", "seq").collect():
        at = got[q.relation_id]
        if q.ring_id == len(at):
            at.append([])
        assert q.ring_id == len(at) - 1 and q.seq == len(at[-1])
        at[-1].append((q.x, q.y))
    want = {r: plain_rings(ways) for r, ways in relations.items()}
    assert sum(map(len, want.values())) > 30 and dict(got) == {r: v for r, v in want.items() if v}


def test_a_ring_of_very_many_ways():
    n = 100_000
    order = list(range(n))
    random.Random(15).shuffle(order)
    spot = lambda k: {"x": float(k % n), "y": 0.0}
    ways = [{"way_no": i, "a": spot(k + i % 2), "b": spot(k + 1 - i % 2), "n": 2} for i, k in enumerate(order)]
    told = streets._joined(ways)
    assert len(told) == n and {t["ring_id"] for t in told} == {0} and [t["at"] for t in told] == list(range(n))


def ring_edges(rings):
    """(r_id, ax, ay, bx, by) of open rings by name."""
    return [(k, *map(float, p), *map(float, q)) for k, ring in rings.items() for p, q in zip(ring, ring[1:] + ring[:1], strict=True)]


EDGES = "r_id long, ax double, ay double, bx double, by double"


def test_dissolved_areas_against_unit_cells(spark):
    """Boxes of whole numbers that touch, overlap, hold one another, repeat and meet in corners; areas, outlines and parts by unit cells."""
    rnd = random.Random(8)
    for n in (4, 14, 40):
        boxes = []
        for _ in range(n):
            x, y = rnd.randrange(18), rnd.randrange(18)
            boxes.append((x, y, x + rnd.randint(1, 6), y + rnd.randint(1, 6)))
        boxes += boxes[:3]
        covered = {(i, j) for x0, y0, x1, y1 in boxes for i in range(x0, x1) for j in range(y0, y1)}
        outline = sum((i + di, j + dj) not in covered for i, j in covered for di, dj in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        parts, left = [], set(covered)
        while left:
            todo, size = [left.pop()], 0
            while todo:
                i, j = todo.pop()
                size += 1
                for spot in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if spot in left:
                        left.remove(spot)
                        todo.append(spot)
            parts.append(size)
        rings = {k: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)] for k, (x0, y0, x1, y1) in enumerate(boxes)}
        got = planar.dissolved(spark.createDataFrame(ring_edges(rings), EDGES), cell=5.0).collect()
        area = collections.defaultdict(float)
        for r in got:
            area[r.r_id] += (r.ax * r.by - r.bx * r.ay) / 2
        assert sorted(round(a, 6) for a in area.values()) == sorted(parts)
        assert sum(abs(r.bx - r.ax) + abs(r.by - r.ay) for r in got) == pytest.approx(outline)


def test_dissolved_slanting_areas_and_a_gap(spark):
    """A square of four triangles less one, a frame of four boxes around a gap, and rings that run either way."""
    rings = {1: [(0, 0), (4, 0), (2, 2)], 2: [(4, 0), (2, 2), (4, 4)], 3: [(4, 4), (0, 4), (2, 2)]}
    rings |= {10: [(10, 0), (16, 0), (16, 1), (10, 1)], 11: [(10, 5), (16, 5), (16, 6), (10, 6)], 12: [(10, 1), (10, 5), (11, 5), (11, 1)], 13: [(15, 1), (16, 1), (16, 5), (15, 5)]}
    edges = planar.left_sided(spark.createDataFrame(ring_edges(rings), EDGES))
    got = planar.region_measures(planar.dissolved(edges)).orderBy("x0").collect()
    assert [(r.x0, r.y0, r.x1, r.y1, round(r.area, 6)) for r in got] == [(0, 0, 4, 4, 12), (10, 0, 16, 6, 6 + 6 + 4 + 4)]
    none = spark.createDataFrame([], EDGES)
    assert planar.dissolved(none).count() == 0


def test_clipped_rings_against_small_squares(spark):
    """The area inside a frame by counting the middles of small squares, for rings that are not convex, run either way and leave the frame often."""
    rng = np.random.default_rng(12)
    rings = {}
    for k in range(40):
        n = rng.integers(4, 12)
        turn = 2 * np.pi * (np.arange(n) + rng.uniform(0, 0.9, n)) / n  # less than half a turn apart, so no ring crosses itself
        size = rng.uniform(1, 9, len(turn))
        rings[k] = np.stack([5 + size * np.cos(turn), 5 + size * np.sin(turn)], 1)[:: 1 if k % 2 else -1]
    rings[50] = np.asarray([(0, 0), (12, 0), (12, 2), (4, 2), (4, 4), (12, 4), (12, 6), (0, 6.0)])  # leaves twice
    rings[51] = np.asarray([(20, 20), (30, 20), (30, 30.0)])
    rings[52] = np.asarray([(2, 0), (2, 2), (6, 2), (6, 0.0)])  # touches the frame only
    frame = (3.0, 2.0, 8.0, 9.0)
    rows = [(k, [(float(x), float(y)) for x, y in r] + ([tuple(map(float, r[0]))] if k % 3 == 0 else [])) for k, r in rings.items()] + [(60, None), (61, [])]
    got = {r.k: [(p.x, p.y) for p in r.ring] for r in planar.clipped_rings(spark.createDataFrame(rows, "k long, ring array<struct<x:double,y:double>>"), frame).collect()}
    assert not {51, 52, 60, 61} & set(got)
    step = 0.02
    gx, gy = np.meshgrid(np.arange(frame[0] + step / 2, frame[2], step), np.arange(frame[1] + step / 2, frame[3], step))
    for k, ring in rings.items():
        inside = np.zeros(gx.shape, bool)
        for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0), strict=True):
            if ay != by:
                inside ^= ((ay > gy) != (by > gy)) & (gx < ax + (bx - ax) * (gy - ay) / (by - ay))
        p = np.asarray(got.get(k, [(0, 0)]))
        assert k not in got or ((p >= frame[:2]).all() and (p <= frame[2:]).all())
        x, y = p.T
        assert abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2 == pytest.approx(inside.sum() * step * step, abs=0.15)


def test_pairs_of_points_and_regions_are_not_exchanged(spark):
    """What a point meets is settled in the row in which it meets it: nothing is grouped above the join (F1)."""
    ring = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (4.0, 5.0), (0.0, 9.0)]
    sides = [(*ring[k], *ring[(k + 1) % 5]) for k in range(5)]
    points = [(k, k % 10 + 0.5, k // 10 + 0.25) for k in range(100)]
    df = spatial.point_in_polygon(spark.createDataFrame(points, "p_id long, x double, y double"), spark.createDataFrame([(r, *s) for r in range(3) for s in sides], f"r_id long, {SEGMENT}"), cell=16.0)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above and "Union" not in above
    assert sorted((r.p_id, r.r_id) for r in df.collect()) == sorted((k, r) for k, x, y in points for r in range(3) if inside(x, y, sides))


def test_cycles_through_many_blocks(spark, monkeypatch):
    """Blocks follow cycles on their own, and those through several blocks have one name; straight crossings are looked for once (F2, F3, F6)."""
    rnd = random.Random(11)
    lines = [(0.0, float(k), 40.0, float(k)) for k in range(0, 41, 8)] + [(float(k), 0.0, float(k), 40.0) for k in range(0, 41, 8)]
    lines += [(x + 1.0, y + 1.0, x + w, y + 1.0) for x in range(0, 40, 8) for y in range(0, 40, 8) for w in [rnd.uniform(2, 6)]] + [(1.5, 2.5, 6.5, 7.5), (1.5, 7.5, 6.5, 2.5)]
    looked, ask = [], planar._cuts
    monkeypatch.setattr(planar, "_cuts", lambda *a: looked.append(1) or ask(*a))
    pieces = tables.stored(planar.noded(spark.createDataFrame(lines, SEGMENT), cell=4.0), "pieces")
    assert len(looked) == 1
    told = []
    for most in (10**6, 8):
        monkeypatch.setattr(planar, "BLOCK", most)
        rows = planar.cycles(pieces, cell=4.0).collect()
        held = collections.defaultdict(set)
        for r in rows:
            held[r.cycle].add((r.ax, r.ay, r.bx, r.by))
        assert len(rows) == 2 * pieces.count() and len({r.h for r in rows}) == len(rows)
        told.append(sorted(map(sorted, held.values())))
    assert told[0] == told[1] and len(told[0]) > 30


def test_equal_regions_are_tested_once(spark):
    """Regions with the same edges are one in the join; rings of other direction, or with an edge twice, stay apart (F5)."""
    box = lambda x, y, w: [(x, y, x + w, y), (x + w, y, x + w, y + w), (x + w, y + w, x, y + w), (x, y + w, x, y)]
    polygons = {r: box(r % 3 * 5.0, r % 2 * 3.0, 9.0) for r in range(60)} | {60: [(c, d, a, b) for a, b, c, d in box(0.0, 0.0, 9.0)], 61: box(0.0, 0.0, 9.0) * 2, 62: [e for k in range(30) for e in box(float(k), float(k), 0.5)]}
    edges = spark.createDataFrame([(r, *e) for r, es in polygons.items() for e in es], f"r_id long, {SEGMENT}")
    shapes, ids = spatial.alike(edges)
    assert shapes.select("r_id").distinct().count() == 9 and sorted(x for r in ids.collect() for x in r.ids) == sorted(polygons)
    points = [(k, k % 20 + 0.5, k // 20 + 0.25) for k in range(400)]
    df = spatial.point_in_polygon(spark.createDataFrame(points, "p_id long, x double, y double"), edges, cell=16.0, repeats=True)
    assert sorted((r.p_id, r.r_id) for r in df.collect()) == sorted((k, r) for k, x, y in points for r, es in polygons.items() if inside(x, y, es))


def test_a_region_of_many_edges_is_parted_into_small_cells(spark):
    """A comb of 2,000 teeth is met in rows of few edges, and corners are not tried against all edges of their row (F3, F6)."""
    n = 2000
    teeth = [p for k in range(n) for p in ((k * 0.25, 0.0), (k * 0.25 + 0.125, 100.0))]
    ring = [*teeth, (n * 0.25, 0.0), (n * 0.25, -5.0), (0.0, -5.0)]
    sides = [(*ring[k - 1], *ring[k]) for k in range(len(ring))]
    edges = spark.createDataFrame([(1, *e) for e in sides], f"r_id long, {SEGMENT}")
    dots = spark.createDataFrame([(1, k * 0.25, k % 7 * 1.0, k * 0.25 + 0.125, k % 7 * 1.0) for k in range(n)], f"r_id long, {SEGMENT}")
    assert C.narrowed(dots, 500.0, 32, "r_id") == 62.5 and C.narrowed(edges, 500.0, 32, "r_id") >= 100.0
    rows = spatial.region_cells(edges, C.Cells(8.0))
    told = {(r.ci, r.cj): (r.odd, r.edges) for r in rows.collect()}
    assert all(odd == inside((i + 1) * 8.0, j * 8.0, sides) for (i, j), (odd, _) in told.items())
    rnd = random.Random(1)
    points = [(k, rnd.randrange(4100) * 0.125, rnd.randrange(-24, 408) * 0.25) for k in range(500)]
    got = spatial.point_in_polygon(spark.createDataFrame(points, "p_id long, x double, y double"), edges).collect()
    assert sorted(r.p_id for r in got) == [k for k, x, y in points if inside(x, y, sides)]


def test_shores_beyond_the_usual_frame(spark, tmp_path):
    """Shores of more customers than the smallest tables have are clipped at the extent of the data, as the SQL does (F6)."""
    duckdb.sql("SELECT unnest([1, 7, 14999, 20000, 90001])::BIGINT AS c_custkey").write_parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    want = con.execute(with_views(map_queries.ORACLE["frame_clip"])).fetchall()
    got = map_queries.frame_clip(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 5


def test_the_sea_of_shores_beyond_the_usual_frame(spark, tmp_path):
    """Bays beyond the usual frame are regions of their own, and the sea's row is that of the SQL (F1)."""
    duckdb.sql("SELECT unnest([1, 2, 6, 14998, 15404, 20000, 20004, 90002])::BIGINT AS c_custkey").write_parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    con.execute("CREATE VIEW orders AS SELECT 0::BIGINT AS o_orderkey, 2::BIGINT AS o_custkey")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    for name in ("wet_regions", "region_reject"):
        want = con.execute(with_views(map_queries.ORACLE[name])).fetchall()
        got = map_queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == [pytest.approx(r) for r in sorted(want)] and len(want) == 7


def test_of_equally_far_vertices_the_first_parts_a_line(spark):
    """Two distances that differ by their last bits only are equal (F7, F10)."""
    places = [(24.25, 77.5), (38.25, 71.5), (44.25, 56.5), (13.25, 39.5), (69.25, 62.5)]
    v = spark.createDataFrame([(1, k, x, y) for k, (x, y) in enumerate(places)], "road_id long, seq long, x double, y double")
    assert sorted(r.seq for r in streets.line_simplify(v, 6.0).collect()) == [0, 2, 3, 4]


def test_crowded_streets_leave_few_pairs(spark):
    """Of 3,000 lines within reach of 500 points few stay for each point, and among them its nearest, ties included (F4, F5)."""
    rnd = np.random.default_rng(5)
    x, y = rnd.integers(0, 40, 500) + 0.125, rnd.integers(0, 40, 500) + 0.375
    a = rnd.integers(0, 40, (3000, 2)).astype(float)
    lines = np.column_stack([a, a + rnd.integers(-9, 10, (3000, 2))])
    i, j = spatial._closest(x, y, lines, 30.0)
    dx, dy = lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1]
    square = np.where(dx * dx + dy * dy > 0, dx * dx + dy * dy, 1.0)
    t = np.clip(((x[:, None] - lines[:, 0]) * dx + (y[:, None] - lines[:, 1]) * dy) / square, 0, 1)
    d = np.hypot(x[:, None] - lines[:, 0] - t * dx, y[:, None] - lines[:, 1] - t * dy)
    want = {(int(p), int(q)) for p, q in np.argwhere(d <= np.minimum(d.min(axis=1), 30.0)[:, None] + 1e-9)}
    assert want <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(i) < 3 * len(x)


def test_rounds_do_not_add_up_on_disk(spark):
    """Of the tables that naming cycles stores in turns, only those that the result reads are left (F2)."""
    n = 60
    ring = [(k, 0, k + 1, 0) for k in range(n)] + [(n, 0, 0, 9), (0, 0, 0, 9)]
    folder = tables.run_folder(spark)
    left = lambda: {f for f in os.listdir(folder) if f.startswith(("steps-", "halves-", "turns-"))} if os.path.isdir(folder) else set()
    had = left()
    named = planar.cycles(spark.createDataFrame(ring, "ax long, ay long, bx long, by long"))
    assert len(left() - had) == 2
    assert named.select("cycle").distinct().count() == 2
