"""Inputs of the registered queries, as views over the base tables; the same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels"]

VIEWS: dict[str, str] = {
    "fx_scripts": "SELECT doc_id AS script_id, text AS raw FROM documents",
    "fx_timed_lines": """SELECT conv_id AS script_id, turn AS line_index, CASE turn % 4
        WHEN 0 THEN '00:' || lpad(CAST(turn * 7 % 60 AS VARCHAR(2)), 2, '0') || ' - ' || replace(text, chr(10), ' ')
        WHEN 1 THEN '[1:' || lpad(CAST(turn * 7 % 60 AS VARCHAR(2)), 2, '0') || '] ' || replace(text, chr(10), ' ')
        WHEN 2 THEN replace(text, chr(10), ' ')
        ELSE '1:02:' || lpad(CAST(turn * 7 % 60 AS VARCHAR(2)), 2, '0') || ' ' || replace(text, chr(10), ' ') END AS raw_line
      FROM conversations""",
    "fx_templates": """SELECT CAST(min(p_partkey) AS BIGINT) AS tpl_pos, p_name AS name,
        lower(min(p_type)) AS emotion_a, lower(max(p_type)) AS emotion_b, lower(min(p_brand)) AS tag_a, lower(max(p_brand)) AS tag_b
      FROM part GROUP BY p_name""",
    "fx_names": """SELECT p_partkey AS q_id, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name, ' ', 1)
        WHEN 2 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) WHEN 3 THEN 'the ' || p_name || ' meme' ELSE 'zzqx' END AS q
      FROM part""",
    "fx_critiqued": """SELECT CAST(floor(doc_id / 50) AS BIGINT) AS script_id, doc_id % 10 AS line_index, doc_id * 3 + k AS pos,
        1 + (doc_id * 7 + k * 3) % 5 AS s1, 1 + (doc_id * 11 + k) % 5 AS s2, 1 + (doc_id * 13 + k * 2) % 5 AS s3, 1 + (doc_id + k) % 5 AS s4,
        (quality = 1 OR k = 0) AS passes, (toxic = 0 AND k <> 1) AS has_alt
      FROM labels CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t""",
    "fx_road_vertices": """SELECT l_orderkey AS road_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
          l_shipdate, l_returnflag, l_linestatus) - 1 AS BIGINT) AS seq,
        CAST((l_orderkey % 100) * 100 + l_partkey % 97 + 0.25 AS DOUBLE) AS x,
        CAST((CAST(floor(l_orderkey / 100) AS BIGINT) % 100) * 100 + (l_suppkey * 7 + l_linenumber * 13) % 89 + 0.5 AS DOUBLE) AS y,
        l_orderkey % 10 AS class_no
      FROM lineitem""",
    "fx_buildings": """SELECT o_orderkey AS b_id, CAST((o_orderkey % 100) * 100 + o_custkey % 83 + 0.125 AS DOUBLE) AS cx,
        CAST((CAST(floor(o_orderkey / 100) AS BIGINT) % 100) * 100 + (o_custkey * 3 % 71) + 0.375 AS DOUBLE) AS cy,
        CAST(4 + o_custkey % 13 AS DOUBLE) AS w, CAST(4.5 + o_orderkey % 29 AS DOUBLE) AS h, CAST(o_orderkey % 90 AS DOUBLE) AS rot,
        CASE o_orderkey % 7 WHEN 0 THEN '2' WHEN 1 THEN '1.5' WHEN 2 THEN '2;3' WHEN 3 THEN '3,5' WHEN 4 THEN 'x' WHEN 5 THEN '0' ELSE NULL END AS levels_tag,
        CASE o_orderkey % 4 WHEN 0 THEN 'house' WHEN 1 THEN 'yes' WHEN 2 THEN 'retail' ELSE 'terrace' END AS kind
      FROM orders""",
    "fx_ring_vertices": """SELECT b_id, CAST(k AS BIGINT) AS seq, cx + sx * w / 2 * cos(radians(rot)) - sy * h / 2 * sin(radians(rot)) AS x,
        cy + sx * w / 2 * sin(radians(rot)) + sy * h / 2 * cos(radians(rot)) AS y
      FROM fx_buildings CROSS JOIN (SELECT 0 AS k, -1 AS sx, -1 AS sy UNION ALL SELECT 1, 1, -1 UNION ALL SELECT 2, 1, 1 UNION ALL SELECT 3, -1, 1
        UNION ALL SELECT 4, -1, -1) c""",
    "fx_drums": """SELECT c_custkey AS d_id, CAST(k AS BIGINT) AS seq, CAST(c_custkey * 20.0 + 0.3 + (3 + c_custkey % 5) * cos(radians(k * 15)) AS DOUBLE) AS x,
        CAST(0.7 + (3 + c_custkey % 5) * sin(radians(k * 15)) AS DOUBLE) AS y
      FROM customer CROSS JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) n WHERE k < 24""",
    "fx_regions": """SELECT CAST(s_suppkey AS BIGINT) AS r_id, CAST((s_suppkey * 37 % 100) * 100 AS DOUBLE) AS x0, CAST((s_suppkey * 59 % 100) * 100 AS DOUBLE) AS y0,
        CAST((s_suppkey * 37 % 100) * 100 + 300 + s_suppkey % 3 * 100 AS DOUBLE) AS x1, CAST((s_suppkey * 59 % 100) * 100 + 400 AS DOUBLE) AS y1
      FROM supplier""",
    "fx_bays": """SELECT c_custkey AS k, CAST(c_custkey % 151 * 60 + 10 AS DOUBLE) AS x0, CAST(floor(c_custkey / 151) * 60 + 10 AS DOUBLE) AS y0,
        CAST(c_custkey % 151 * 60 + 40 + c_custkey % 3 * 5 AS DOUBLE) AS x1, CAST(floor(c_custkey / 151) * 60 + 40 + c_custkey % 3 * 5 AS DOUBLE) AS y1
      FROM customer""",
    "fx_coast": """SELECT k * 4 + side AS s_id, CAST(CASE WHEN k % 2 = 0 THEN pt ELSE 1 - pt END AS BIGINT) AS seq,
        CASE side WHEN 0 THEN CASE pt WHEN 0 THEN x1 + 5 ELSE x0 - 5 END WHEN 1 THEN x0 WHEN 2 THEN CASE pt WHEN 0 THEN x0 - 5 ELSE x1 + 5 END ELSE x1 END AS x,
        CASE side WHEN 0 THEN y0 WHEN 1 THEN CASE pt WHEN 0 THEN y0 - 5 ELSE y1 + 5 END WHEN 2 THEN y1 ELSE CASE pt WHEN 0 THEN y1 + 5 ELSE y0 - 5 END END AS y
      FROM fx_bays CROSS JOIN (SELECT 0 AS side UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s CROSS JOIN (SELECT 0 AS pt UNION ALL SELECT 1) p
      WHERE k % 5 <> 0 OR side <> 2""",
    "fx_tiles": """SELECT o_orderkey AS t_id, CAST(floor(o_orderkey / 120) AS BIGINT) AS strip, o_orderkey % 120 AS place, CAST(o_orderkey % 120 * 60 + 5 AS DOUBLE) AS x0, CAST(floor(o_orderkey / 120) * 100 + 10 AS DOUBLE) AS y0,
        CAST(o_orderkey % 120 * 60 + 65 AS DOUBLE) AS x1, CAST(floor(o_orderkey / 120) * 100 + 50 + o_custkey % 4 * 10 AS DOUBLE) AS y1
      FROM orders WHERE o_custkey % 7 <> 0""",
    "fx_homes": """SELECT o_orderkey AS p_id, CAST(o_custkey % 151 * 60 + 30 + o_orderkey % 7 AS DOUBLE) AS x, CAST(floor(o_custkey / 151) * 60 + 20 + o_orderkey % 11 AS DOUBLE) AS y,
        o_custkey AS k
      FROM orders""",
    "fx_elements": """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS type, o_orderkey AS id,
        CASE o_orderkey % 8 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary_link' END AS highway,
        CASE o_orderkey % 8 WHEN 2 THEN 'water' WHEN 3 THEN 'wood' END AS natural_tag, CASE o_orderkey % 8 WHEN 4 THEN 'river' END AS waterway,
        CASE o_orderkey % 8 WHEN 5 THEN 'yes' END AS building, CASE o_orderkey % 8 WHEN 6 THEN 'park' END AS leisure,
        CASE o_orderkey % 8 WHEN 7 THEN 'retail' END AS landuse, CASE o_orderkey % 5 WHEN 0 THEN 'parking' WHEN 1 THEN 'theatre' END AS amenity,
        CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '-1.0' WHEN 2 THEN 'up' END AS layer_tag,
        CAST(52.6 + (o_custkey % 100) * 0.001 AS DOUBLE) AS lat, CAST(-8.7 + (o_orderkey % 120) * 0.001 AS DOUBLE) AS lon, o_custkey % 6 AS n_pts
      FROM orders""",
    "fx_points": "SELECT s_suppkey AS p_id, CAST((s_suppkey * 97 % 10000) + 0.5 AS DOUBLE) AS x, CAST((s_suppkey * 389 % 10000) + 0.5 AS DOUBLE) AS y FROM supplier",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or base table as a DataFrame; nothing is registered in the catalogue."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = [t for t in [*VIEWS, *TABLES] if re.search(rf"\bFROM {t}\b", sql)]
    if "FROM nation)" in sql and "nation" not in used:
        used.append("nation")
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: fixture(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """DuckDB SQL in front of which the views that it reads stand as common tables."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(VIEWS[name])
                need.append(name)

    visit(sql)
    head = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in need)
    body = sql.strip()
    if not need:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
