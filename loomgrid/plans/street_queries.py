"""Registered queries over roads and their bearings, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import geometry as G
from loomgrid.operators import streets as R
from loomgrid.plans.fixtures import fixture

ROTATION = 31.61
#: Class names of the fixtures' class numbers.
CLASSES = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "living_street", "pedestrian", "service", "primary_link"]
_CLASS = "CASE class_no " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CLASSES)) + " END"
_RANK = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.ROAD_RANK.items()) + " ELSE 7 END"
_WIDTH = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in {**R.ROAD_WIDTH_M, **{f"{k}_link": f"{R.ROAD_WIDTH_M[k]} * 0.7" for k in R.LINKED}}.items()) + " ELSE 6.0 END"
_PM = "fmod(fmod({0}, {1}) + {1}, {1})"
_SEG = """seg AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length FROM (SELECT road_id, class_no, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
  FROM fx_road_vertices WINDOW w AS (PARTITION BY road_id ORDER BY seq)) WHERE x2 IS NOT NULL)"""
_BEAR = _SEG + f", bear AS (SELECT road_id, seq, x1, y1, {_PM.format('degrees(atan2(x2 - x1, y2 - y1))', '360.0')} AS bearing, length FROM seg WHERE length >= 1e-6)"
_ROSE = _BEAR + """, rose AS (SELECT r.bin, coalesce(sum(length), 0.0) AS length FROM range(36) r(bin) LEFT JOIN (SELECT length, CAST(floor((fmod(bearing + d, 360.0) + 5) / 10) AS BIGINT) % 36 AS bin
  FROM bear CROSS JOIN (SELECT 0.0 AS d UNION ALL SELECT 180.0)) b ON b.bin = r.bin GROUP BY r.bin)"""
_OFF = "least(" + _PM.format("({0} - {1})", "45.0") + ", 45.0 - " + _PM.format("({0} - {1})", "45.0") + ")"

QUERIES, ORACLE = {}, {}


def register(sql: str | None = None):
    """Register the query under its function's name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _vertices(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_road_vertices")


def _bearings(spark: SparkSession, d: str) -> DataFrame:
    return R.segment_bearings(_vertices(spark, d))


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


@register(f"WITH {_BEAR} SELECT road_id, seq, round(bearing, 4) AS bearing, round(length, 4) AS length FROM bear")
def segment_bearings(spark, d):
    return _rounded(_bearings(spark, d), "bearing", "length")


@register(f"WITH {_ROSE} SELECT bin, round(length, 3) AS length FROM rose")
def bearing_rose(spark, d):
    return _rounded(R.bearing_rose(_bearings(spark, d)), "length", digits=3)


@register(f"""WITH {_BEAR}, f AS (SELECT sum(length * cos(radians(4 * bearing))) AS c, sum(length * sin(radians(4 * bearing))) AS s, sum(length) AS t, count(*) AS n FROM bear)
  SELECT round({_PM.format('degrees(atan2(s, c)) / 4', '90.0')}, 4) AS grid_angle, round(sqrt(c * c + s * s) / t, 4) AS strength, round(t, 3) AS total_length, n AS n_segments FROM f""")
def grid_fit(spark, d):
    return _rounded(_rounded(R.grid_fit(_bearings(spark, d)), "grid_angle", "strength"), "total_length", digits=3)


@register(f"""WITH {_ROSE}, h AS (SELECT -sum(CASE WHEN length > 0 THEN length / t * log2(length / t) ELSE 0 END) AS h FROM rose, (SELECT sum(length) AS t FROM rose))
  SELECT round(h, 4) AS entropy, round(least(1.0, greatest(0.0, 1 - pow((h - 2) / (log2(36) - 2), 2))), 4) AS orderliness FROM h""")
def rose_entropy(spark, d):
    return _rounded(R.rose_entropy(R.bearing_rose(_bearings(spark, d))), "entropy", "orderliness")


@register(f"""WITH {_BEAR}, a AS (SELECT road_id, seq, fmod(bearing, 90.0) AS g FROM bear), o AS (SELECT road_id, seq, g - 90.0 * k AS v, row_number() OVER (PARTITION BY road_id, seq ORDER BY abs(g - 90.0 * k), k) AS n FROM a CROSS JOIN range(4) r(k))
  SELECT road_id, seq, round(v, 4) AS rotation FROM o WHERE n = 1""")
def fit_rotation(spark, d):
    b = _bearings(spark, d)
    return _rounded(b.select("road_id", "seq", R.fit_rotation(F.pmod("bearing", F.lit(90.0))).alias("rotation")), "rotation")


@register(f"WITH {_BEAR}, w AS (SELECT k * 0.5 AS rotation, {_OFF.format('bearing', 'k * 0.5')} AS o, length FROM bear CROSS JOIN range(90) r(k)) SELECT CAST(rotation AS DOUBLE) AS rotation, round(sum(length * o), 2) AS bend FROM w GROUP BY rotation")
def rotation_sweep(spark, d):
    s = R.rotation_sweep(_bearings(spark, d), [k * 0.5 for k in range(90)])
    return _rounded(s.groupBy("rotation").agg(F.sum(F.col("length") * F.col("offset")).alias("bend")), "bend", digits=2)


_PROFILE = _BEAR + f", w AS (SELECT k * 0.5 AS rotation, {_OFF.format('bearing', 'k * 0.5')} AS o, length FROM bear CROSS JOIN range(90) r(k)), p AS (SELECT rotation, sum(CASE WHEN o <= 5.0 + 1e-9 THEN length ELSE 0 END) / sum(length) AS share FROM w GROUP BY rotation)"


def _profile(spark, d):
    return R.alignment_profile(_bearings(spark, d))


@register(f"WITH {_PROFILE} SELECT round(rotation, 4)::DOUBLE AS rotation, round(share, 4) AS share FROM p")
def alignment_profile(spark, d):
    return _rounded(_profile(spark, d), "rotation", "share")


@register(f"WITH {_PROFILE} SELECT round(rotation, 4)::DOUBLE AS rotation FROM p ORDER BY round(share, 9) DESC, rotation LIMIT 1")
def best_rotation(spark, d):
    return _rounded(R.best_rotation(_profile(spark, d)), "rotation")


@register(f"WITH {_BEAR} SELECT round(sum(length * {_OFF.format('bearing', ROTATION)}) / sum(length), 4) AS cost FROM bear")
def snap_cost(spark, d):
    return _rounded(R.snap_cost(_bearings(spark, d), ROTATION), "cost")


_TURNS = [31.61, 29.5, 0.25, 32.75]


@register(f"""WITH {_BEAR}, w AS (SELECT r AS rotation, x1 < 3000 AS core, length, {_OFF.format('bearing', 'r')} AS o FROM bear CROSS JOIN (SELECT unnest([31.61, 29.5, 0.25, 32.75])::DOUBLE AS r))
  SELECT rotation, round(sum(length) FILTER (core AND o <= 5.0) / sum(length) FILTER (core), 4) AS core_share, round(sum(length * o) FILTER (core) / sum(length) FILTER (core), 4) AS core_bend,
  round(sum(length) FILTER (o <= 5.0) / sum(length), 4) AS city_share, round(sum(length * o) / sum(length), 4) AS city_bend FROM w GROUP BY rotation""")
def rotation_compare(spark, d):
    b = R.segment_bearings(_vertices(spark, d), extra=("x",))  # a segment's row has the columns of its first vertex
    return _rounded(R.rotation_compare(b, F.col("x") < 3000, _TURNS), "core_share", "core_bend", "city_share", "city_bend")


@register(f"WITH {_BEAR} SELECT round(coalesce(sum(CASE WHEN {_OFF.format('bearing', ROTATION)} <= 2.0 THEN length ELSE 0 END) / sum(length), 0), 4) AS share FROM bear")
def crisp_share(spark, d):
    return _rounded(R.crisp_share(_bearings(spark, d), ROTATION), "share")


@register(f"""SELECT road_id AS id, {_CLASS} AS highway, CASE WHEN road_id % 3 = 0 THEN 'Road ' || road_id END AS name, CAST({_WIDTH.format(_CLASS)} AS DOUBLE) AS width_m, road_id % 7 = 0 AS bridge, road_id % 11 = 0 AS tunnel, CAST(CASE road_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -2 ELSE 0 END AS INTEGER) AS layer
  FROM fx_road_vertices GROUP BY road_id, class_no HAVING count(*) >= 2 UNION ALL SELECT road_id, 'rail', NULL, 5.0, false, road_id % 11 = 0, 0 FROM fx_road_vertices WHERE class_no = 8 GROUP BY road_id HAVING count(*) >= 2""")
def roads_typed(spark, d):
    n = _vertices(spark, d).groupBy(F.col("road_id").alias("id"), "class_no").agg(F.count("*").alias("n_pts"))
    tag = lambda k, when, v: F.when(when, F.struct(F.lit(k).alias("k"), (v if not isinstance(v, str) else F.lit(v)).alias("v")))
    rid = F.col("id")
    highway = F.get(F.array(*map(F.lit, CLASSES)), F.col("class_no"))
    pairs = [tag("highway", F.lit(True), highway), tag("name", rid % 3 == 0, F.concat(F.lit("Road "), rid)), tag("bridge", rid % 7 == 0, "yes"), tag("tunnel", F.lit(True), F.when(rid % 11 == 0, "yes").otherwise("")), tag("layer", F.lit(True), F.when(rid % 4 == 0, "1").when(rid % 4 == 1, "-2.7").otherwise("ground"))]
    e = n.select("id", F.lit("way").alias("type"), "n_pts", "class_no", F.map_from_entries(F.array_compact(F.array(*pairs))).alias("tags"))
    rails = e.where("class_no = 8").withColumn("tags", F.map_from_entries(F.array(F.struct(F.lit("railway").alias("k"), F.lit("tram").alias("v")), F.struct(F.lit("tunnel").alias("k"), F.try_element_at("tags", F.lit("tunnel")).alias("v")))))
    return R.roads_typed(e).unionByName(R.roads_typed(rails, rail=True))


@register(f"SELECT road_id, CAST({_RANK.format(_CLASS)} AS INTEGER) AS importance FROM fx_road_vertices GROUP BY road_id, class_no HAVING {_RANK.format(_CLASS)} <= 6")
def road_importance(spark, d):
    roads = _vertices(spark, d).select("road_id", F.get(F.array(*map(F.lit, CLASSES)), F.col("class_no")).alias("highway")).distinct()
    return roads.select("road_id", R.road_importance(F.col("highway")).alias("importance")).where("importance <= 6")


@register(f"""WITH {_SEG}, f AS (SELECT road_id, greatest(0.0, least(1.0, CASE WHEN length > 0 THEN ((5000.0 - x1) * (x2 - x1) + (5000.0 - y1) * (y2 - y1)) / (length * length) ELSE 0 END)) AS t, x1, y1, x2, y2 FROM seg),
  g AS (SELECT road_id, min(sqrt(pow(x1 + t * (x2 - x1) - 5000.0, 2) + pow(y1 + t * (y2 - y1) - 5000.0, 2))) AS distance FROM f GROUP BY road_id) SELECT road_id, round(distance, 3) AS distance FROM g WHERE distance <= 450""")
def radius_filter(spark, d):
    return _rounded(R.radius_filter(_vertices(spark, d), 5000.0, 5000.0), "distance", digits=3)


@register("SELECT DISTINCT p_brand AS name FROM part ORDER BY name LIMIT 12")
def street_names(spark, d):
    return fixture(spark, d, "part").select(F.col("p_brand").alias("name")).where("name <> ''").distinct().orderBy("name").limit(12)


_KEYS = "k AS (SELECT *, CAST(round_even(x / 1.5, 0) AS BIGINT) AS kx, CAST(round_even(y / 1.5, 0) AS BIGINT) AS ky FROM fx_road_vertices)"
_CHAIN = _KEYS + ", chain AS MATERIALIZED (SELECT * FROM (SELECT *, lag(kx) OVER w AS px, lag(ky) OVER w AS py FROM k WINDOW w AS (PARTITION BY road_id ORDER BY seq)) WHERE px IS NULL OR px <> kx OR py <> ky)"
_NODES = _CHAIN + ", n0 AS MATERIALIZED (SELECT kx, ky, arg_min(x, road_id * 100000 + seq) AS x, arg_min(y, road_id * 100000 + seq) AS y FROM k GROUP BY kx, ky)"


@register(f"WITH {_CHAIN} SELECT road_id, seq, kx, ky FROM chain")
def dedupe_consecutive(spark, d):
    return R.dedupe_consecutive(_vertices(spark, d)).select("road_id", "seq", "kx", "ky")


@register(f"WITH {_NODES} SELECT kx, ky, x, y FROM n0")
def node_first_seen(spark, d):
    return R.node_first_seen(_vertices(spark, d))


def _round_sql(k: int, keys: str, links: str, anchor: float) -> str:
    """One relaxation round as common tables, from nodes n{k} to n{k+1}; keys are those of a node."""
    cols = keys.split(",")
    on = lambda s: " AND ".join(f"l.{s}_{c} = {s}.{c}" for c in cols)
    both = lambda s: ", ".join(f"{s}_{c} AS {c}" for c in cols)
    angle = f"radians({_PM.format(f'(round_even({_PM.format(f'(degrees(atan2(b.x - a.x, b.y - a.y)) - {ROTATION})', '360.0')} / 45.0, 0) * 45.0 + {ROTATION})', '360.0')})"
    ends = ", ".join(f"l.{s}_{c}" for s in "ab" for c in cols)
    return f""", h{k} AS MATERIALIZED (SELECT {ends}, sin({angle}) AS ux, cos({angle}) AS uy, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, l.length / 2 AS half FROM {links} l JOIN n{k} a ON {on('a')} JOIN n{k} b ON {on('b')}),
  w{k} AS MATERIALIZED (SELECT {keys}, avg(tx) AS tx, avg(ty) AS ty FROM (SELECT {both('a')}, mx - ux * half AS tx, my - uy * half AS ty FROM h{k} UNION ALL SELECT {both('b')}, mx + ux * half, my + uy * half FROM h{k}) GROUP BY {keys}),
  n{k + 1} AS MATERIALIZED (SELECT {keys}, coalesce(tx * {1 - anchor} + x * {anchor}, x) AS x, coalesce(ty * {1 - anchor} + y * {anchor}, y) AS y FROM n0 LEFT JOIN w{k} USING ({keys}))"""


_NET = _NODES + """, c AS (SELECT kx AS a_kx, ky AS a_ky, lead(kx) OVER w AS b_kx, lead(ky) OVER w AS b_ky FROM chain WINDOW w AS (PARTITION BY road_id ORDER BY seq)),
  links AS MATERIALIZED (SELECT a_kx, a_ky, b_kx, b_ky, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS length FROM c JOIN n0 a ON a_kx = a.kx AND a_ky = a.ky JOIN n0 b ON b_kx = b.kx AND b_ky = b.ky WHERE sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) >= 4.0)"""


ROUNDS = 60


@register(f"WITH {_NET}{''.join(_round_sql(k, 'kx,ky', 'links', 0.04) for k in range(ROUNDS))} SELECT kx, ky, round(x, 3) AS x, round(y, 3) AS y FROM n{ROUNDS}")
def network_relax(spark, d):
    return _rounded(R.network_relax(_vertices(spark, d), ROTATION, iterations=ROUNDS), "x", "y", digits=3)


_RING = """n0 AS MATERIALIZED (SELECT b_id AS ring, seq AS idx, x, y FROM fx_ring_vertices WHERE seq < 4), rl AS MATERIALIZED (SELECT a.ring AS a_ring, a.idx AS a_idx, b.ring AS b_ring, b.idx AS b_idx, sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS length
  FROM n0 a JOIN n0 b ON a.ring = b.ring AND b.idx = (a.idx + 1) % 4)"""


@register(f"WITH {_RING}{''.join(_round_sql(k, 'ring,idx', 'rl', 0.12) for k in range(ROUNDS))} SELECT ring, idx, round(x, 3) AS x, round(y, 3) AS y FROM n{ROUNDS}")
def ring_relax(spark, d):
    rings = fixture(spark, d, "fx_ring_vertices").where("seq < 4").select(F.col("b_id").alias("ring"), F.col("seq").alias("idx"), "x", "y")
    return _rounded(R.ring_relax(rings, ROTATION, iterations=ROUNDS), "x", "y", digits=3)


@register(f"""WITH {_SEG}, s AS (SELECT *, CASE WHEN length > 20.0 THEN CAST(floor(length / 20.0) AS INTEGER) + 1 ELSE 1 END AS n FROM seg)
  SELECT road_id, seq, CAST(k AS INTEGER) AS step, round(x1 + (x2 - x1) * k / n, 3) AS x, round(y1 + (y2 - y1) * k / n, 3) AS y FROM s, unnest(range(n)) u(k)""")
def densify(spark, d):
    return _rounded(R.densify(R.segments(_vertices(spark, d)), 20.0), "x", "y", digits=3).select("road_id", "seq", "step", "x", "y")


@register(f"""WITH {_BEAR} SELECT road_id, seq, round({_PM.format(f'(bearing - {ROTATION})', '360.0')}, 4) AS rotated, round({_OFF.format('bearing', ROTATION)}, 4) AS off,
  round({_PM.format(f'(round_even({_PM.format(f"(bearing - {ROTATION})", "360.0")} / 45.0, 0) * 45.0 + {ROTATION})', '360.0')}, 4) AS snapped FROM bear""")
def bearing_math(spark, d):
    b, r = F.col("bearing"), F.lit(ROTATION)
    return _rounded(_bearings(spark, d).select("road_id", "seq", G.rotated(b, r).alias("rotated"), G.offset_from_clean(b, r).alias("off"), G.snapped(b, r).alias("snapped")), "rotated", "off", "snapped")


@register(f"""WITH r AS (SELECT road_id, {_RANK.format(_CLASS)} AS imp, road_id % 7 = 0 AS bridge, road_id % 11 = 0 AS tunnel FROM fx_road_vertices GROUP BY road_id, class_no)
  SELECT road_id, NOT tunnel AND NOT bridge AND imp <= 6 AS pavement, CASE WHEN NOT tunnel AND NOT bridge THEN CASE WHEN imp <= 4 THEN 'major' ELSE 'minor' END END AS carriageway, bridge AND NOT tunnel AS on_bridge FROM r""")
def road_draw_classes(spark, d):
    r = _vertices(spark, d).select("road_id", "class_no").distinct().select("road_id", R.road_importance(F.get(F.array(*map(F.lit, CLASSES)), F.col("class_no"))).alias("imp"), (F.col("road_id") % 7 == 0).alias("bridge"), (F.col("road_id") % 11 == 0).alias("tunnel"))
    return R.draw_classes(r)


@register(f"SELECT road_id, row_number() OVER (ORDER BY {_WIDTH.format(_CLASS)} DESC, road_id) AS place FROM (SELECT DISTINCT road_id, class_no FROM fx_road_vertices)")
def road_order(spark, d):
    r = _vertices(spark, d).select("road_id", "class_no").distinct().select("road_id", R.road_width(F.get(F.array(*map(F.lit, CLASSES)), F.col("class_no"))).alias("width_m"))
    return R.widest_first(r)


_FOOT = "greatest(0.0, least(1.0, CASE WHEN pa.x = pb.x AND pa.y = pb.y THEN 0 ELSE ((v.x - pa.x) * (pb.x - pa.x) + (v.y - pa.y) * (pb.y - pa.y)) / (pow(pb.x - pa.x, 2) + pow(pb.y - pa.y, 2)) END))"
_OFFSET = f"sqrt(pow(v.x - pa.x - {_FOOT} * (pb.x - pa.x), 2) + pow(v.y - pa.y - {_FOOT} * (pb.y - pa.y), 2))"


def _farthest(spans: str) -> str:
    """Of each span (road_id, a, b) its farthest vertex k, the first of equals, and how far that is."""
    return f"""SELECT c.road_id, c.a, c.b, max(o) AS off, arg_min(s, {{'o': -o, 's': s}}) AS k FROM (SELECT c.road_id, c.a, c.b, v.seq AS s, round({_OFFSET}, 9) AS o FROM ({spans}) c
    JOIN fx_road_vertices pa ON pa.road_id = c.road_id AND pa.seq = c.a JOIN fx_road_vertices pb ON pb.road_id = c.road_id AND pb.seq = c.b LEFT JOIN fx_road_vertices v ON v.road_id = c.road_id AND v.seq > c.a AND v.seq < c.b) c GROUP BY c.road_id, c.a, c.b"""


@register(f"""WITH RECURSIVE sp AS ({_farthest('SELECT road_id, min(seq) AS a, max(seq) AS b FROM fx_road_vertices GROUP BY road_id')} UNION ALL {_farthest('SELECT road_id, CASE WHEN t = 0 THEN a ELSE k END AS a, CASE WHEN t = 0 THEN k ELSE b END AS b FROM sp CROSS JOIN range(2) r(t) WHERE off > 6.0')})
  SELECT v.road_id, v.seq, v.x, v.y FROM fx_road_vertices v JOIN (SELECT road_id, a AS seq FROM sp UNION SELECT road_id, b FROM sp) e ON e.road_id = v.road_id AND e.seq = v.seq""")
def line_simplify(spark, d):
    return R.line_simplify(_vertices(spark, d), 6.0)


@register("SELECT b_id AS relation_id, CAST(0 AS BIGINT) AS ring_id, seq, round(x, 3) AS x, round(y, 3) AS y FROM fx_ring_vertices")
def ring_assembly(spark, d):
    v = fixture(spark, d, "fx_ring_vertices")
    # each outline as two ways, the second one backwards
    one = v.where("seq <= 2").select(F.col("b_id").alias("relation_id"), F.lit(0).cast("long").alias("way_no"), "seq", "x", "y")
    two = v.where("seq >= 2").select(F.col("b_id").alias("relation_id"), F.lit(1).cast("long").alias("way_no"), (10 - F.col("seq")).alias("seq"), "x", "y")
    # the outline closes on the very vertex it began with
    first = v.where("seq = 0").select(F.col("b_id").alias("relation_id"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    two = two.join(first, "relation_id").select("relation_id", "way_no", "seq", F.when(F.col("seq") == 6, F.col("x0")).otherwise(F.col("x")).alias("x"), F.when(F.col("seq") == 6, F.col("y0")).otherwise(F.col("y")).alias("y"))
    return _rounded(R.ring_assembly(one.unionByName(two)), "x", "y", digits=3)
