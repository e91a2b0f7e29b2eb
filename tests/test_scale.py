"""What must not grow with the tables: borders that cut small networks, rows of Python objects, one task for all."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgrid.operators import buildings, relaxing, spatial, streets


def test_small_networks_are_whole_in_their_blocks(spark, monkeypatch):
    """No link of a network that is smaller than a block leaves it, so nothing is asked of other blocks."""
    rnd = random.Random(3)
    nodes, links = [], []
    for k in range(40):
        own = [(k % 8 * 30 + i % 5 * 4, k // 8 * 30 + i // 5 * 4) for i in range(20)]
        nodes += [(x, y, x * 1.5 + rnd.random(), y * 1.5) for x, y in own]
        links += [(*own[i], *own[rnd.randrange(i)]) for i in range(1, 20)]
    crossing, asked = [], relaxing.surroundings
    monkeypatch.setattr(relaxing, "surroundings", lambda l, hops: crossing.append(l.where("block <> other_block").count()) or asked(l, hops))
    n = spark.createDataFrame(nodes, "kx long, ky long, x double, y double")
    e = spark.createDataFrame(links, "a_kx long, a_ky long, b_kx long, b_ky long")
    told = [{(r.kx, r.ky): (r.x, r.y) for r in relaxing.relax(n, e, 10.0, 9, 0.04, hops=3, block_nodes=b).collect()} for b in (10_000, 47)]
    assert crossing == [0] and told[0].keys() == told[1].keys() and len(told[0]) == 800
    assert max(np.hypot(told[0][k][0] - told[1][k][0], told[0][k][1] - told[1][k][1]) for k in told[0]) < 1e-9


def test_together():
    rnd = random.Random(5)
    for n in (1, 9, 80):
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(n // 2)]
        want = list(range(n))
        for _ in range(n):
            for a, b in links:
                want[a] = want[b] = min(want[a], want[b])
        assert relaxing.together(*np.asarray(links, int).reshape(-1, 2).T, n).tolist() == want


@pytest.mark.parametrize("lattice", [True, False])
def test_boxes_of_many_rings_are_those_of_each(lattice):
    rnd = np.random.default_rng(7)
    for size in (1, 2, 3, 5, 12):
        p = rnd.integers(0, 4, (60, size, 2)).astype(float) if lattice else rnd.uniform(0, 9, (60, size, 2))
        for ring, got in zip(p, buildings.small_boxes(p), strict=True):
            want = buildings.smallest_box(buildings.hull(ring))
            assert np.isnan(got).all() if want is None else got == pytest.approx(want, abs=1e-9)


def test_outlines_and_lines_leave_spark_as_arrays(spark, capsys):
    v = spark.createDataFrame([(k, s, float(s * s % 7), float(s * k % 5)) for k in range(6) for s in range(k, 9)], "b_id long, seq long, x double, y double")
    for df in (buildings.oriented_box(v), streets.ring_relax(v.toDF("ring", "idx", "x", "y"), 3.0, 2), streets.line_simplify(v, 1.0, "b_id"), streets.ring_assembly(v.selectExpr("b_id relation_id", "seq way_no", "seq", "x", "y"))):
        df.explain()
        assert "MapInPandas" not in (plan := capsys.readouterr().out) and "MapInArrow" in plan


def test_lattices_are_dealt(spark, monkeypatch):
    """Boxes in one part are laid out by many tasks, with the same points."""
    boxes = spark.createDataFrame([(k, 0.0, 0.0, 200.0, 150.0) for k in range(30)], "r_id long, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    side = lambda *c: "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(("ax", "ay", "bx", "by"), c, strict=True)) + ")"
    sides = ", ".join(side(*c) for c in (("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0")))
    edges = boxes.selectExpr("r_id", f"inline(array({sides}))")
    told, parts = [], []
    monkeypatch.setattr(spatial, "crossings", lambda kept, e, ask=spatial.crossings: parts.append(kept.rdd.getNumPartitions()) or ask(kept, e))
    for most in (10**6, 100):
        monkeypatch.setattr(spatial, "LATTICE", most, raising=False)
        told.append(sorted(tuple(r) for r in spatial.grid_sample(boxes, edges).collect()))
    assert told[0] == told[1] and told[0] and parts == [1, 29]


def test_rings_are_snapped_in_their_rows(spark, capsys):
    """Simplified, parted and relaxed after one exchange, as the three steps one after the other do it (F4)."""
    rnd = random.Random(9)
    rows = []
    for r in range(40):
        n, size = rnd.randint(1, 12), rnd.choice([5.0, 90.0, 700.0])
        ring = [(size * np.cos(6.283 * k / n) + rnd.random(), size * np.sin(6.283 * k / n)) for k in range(n)]
        rows += [(r, k, float(x), float(y)) for k, (x, y) in enumerate([*ring, ring[0]])]
    rings = spark.createDataFrame([*rows, (99, 0, 1.0, 1.0)], "ring long, idx long, x double, y double")
    tolerance = lambda area: 30.0 if area > 20_000 else 8.0
    area = {r: abs(sum(a[2] * b[3] - b[2] * a[3] for a, b in zip(p, p[1:]))) / 2 for r in range(40) for p in [[v for v in rows if v[0] == r]]}
    thin = None
    for limit in (8.0, 30.0):
        own = rings.where(F.col("ring").isin([r for r, a in area.items() if tolerance(a) == limit]))
        part = streets.line_simplify(own.withColumnRenamed("idx", "seq"), limit, "ring")
        thin = part if thin is None else thin.unionByName(part)
    parted = streets.densify(streets.segments(thin, "ring"), 120.0)
    numbered = parted.withColumn("idx", F.row_number().over(Window.partitionBy("ring").orderBy("seq", "step")) - 1)
    want = sorted(map(tuple, streets.ring_relax(numbered.select("ring", "idx", "x", "y"), 10.0).collect()))
    df = streets.snap_rings(rings, 10.0, F.when(F.col("area") > 20_000, 30.0).otherwise(8.0))
    df.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    got = sorted(map(tuple, df.collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) > 300
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], atol=1e-9)
