"""Registered queries over sources and sinks: tables derived from the base tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgrid.operators import buildings as B
from loomgrid.plans.fixtures import fixture
from loomgrid.plans.map_queries import _BBOX, _elements, _selector_sql
from loomgrid.sources import tables as S

QUERIES, ORACLE = {}, {}


def register(sql: str | None = None):
    """Register the query under its function's name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _path(spark: SparkSession, name: str) -> str:
    return f"{S.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("SELECT s_suppkey AS script_id, '0:' || lpad(CAST(s_suppkey % 60 AS VARCHAR), 2, '0') || ' - ' || s_name || chr(10) || 'nation ' || s_nationkey AS raw FROM supplier")
def src_scripts(spark, d):
    path = _path(spark, "scripts")
    mark = F.concat(F.lit("0:"), F.lpad((F.col("s_suppkey") % 60).cast("string"), 2, "0"), F.lit(" - "), "s_name", F.lit("\n"), F.lit("nation "), "s_nationkey")
    S.write_scripts(fixture(spark, d, "supplier").select(F.col("s_suppkey").alias("script_id"), mark.alias("value")), path)
    read = S.read_scripts(spark, f"{path}/*")
    return read.select(F.regexp_extract("script_id", r"script_id=(-?\d+)", 1).cast("long").alias("script_id"), F.regexp_replace("raw", r"\n\z", "").alias("raw"))


def _catalogue(spark, d):
    t = fixture(spark, d, "fx_templates")
    region = F.struct(F.col("tag_a").alias("label"), *[F.lit(v).alias(k) for k, v in (("x", 1), ("y", 2), ("width", 3), ("height", 4))])
    return t.select(
        "tpl_pos", "name", F.concat("name", F.lit(".png")).alias("filename"), F.when(F.col("tpl_pos") % 10 == 9, "hologram").otherwise("top_bottom").alias("format"), F.array("emotion_a", "emotion_b").alias("emotions"),
        F.array("tag_a").alias("tags"), F.when(F.col("tpl_pos") % 10 != 8, F.lit("two lines")).alias("humor_convention"), F.array(region).alias("text_regions"), F.when(F.col("tpl_pos") % 2 == 0, F.lit(640)).alias("width"),
    )


@register("SELECT name, emotion_a AS emotion, CAST(CASE WHEN tpl_pos % 2 = 0 THEN 640 ELSE 800 END AS INTEGER) AS width, CAST(32 AS INTEGER) AS font_size FROM fx_templates WHERE tpl_pos % 10 < 8")
def src_templates(spark, d):
    path = _path(spark, "catalogue")
    rows = _catalogue(spark, d).drop("tpl_pos")
    rows.groupBy((F.pmod(F.xxhash64("name"), F.lit(8))).alias("part")).agg(F.collect_list(F.struct(*rows.columns)).alias("templates")).write.partitionBy("part").json(path)
    return S.read_templates(spark, path).select("name", F.col("emotions")[0].alias("emotion"), "width", F.col("text_regions")[0]["font_size"].alias("font_size"))


@register("SELECT name, name || '.png' AS filename, emotion_a || '+' || emotion_b AS emotions, tag_a AS tag, CAST(CASE WHEN tpl_pos % 2 = 0 THEN 640 ELSE 800 END AS INTEGER) AS width FROM fx_templates WHERE tpl_pos % 10 < 8")
def snk_templates(spark, d):
    path = _path(spark, "templates")
    S.write_templates(_catalogue(spark, d).drop("tpl_pos"), path, per_file=500)
    return S.read_templates(spark, path).select("name", "filename", F.array_join("emotions", "+").alias("emotions"), F.col("tags")[0].alias("tag"), "width")


@register("SELECT type, id, lat, lon, amenity FROM fx_elements")
def src_osm_elements(spark, d):
    path = _path(spark, "elements")
    e = _elements(spark, d).select("type", "id", "lat", "lon", "tags", "center")
    packed = e.groupBy((F.pmod(F.xxhash64("id"), F.lit(32))).alias("part")).agg(F.collect_list(F.struct(*e.columns)).alias("elements"))
    packed.write.partitionBy("part").option("compression", "gzip").json(path)  # a file a part
    return S.read_elements(spark, path).select("type", "id", "lat", "lon", F.try_element_at("tags", F.lit("amenity")).alias("amenity"))


@register("SELECT 'way/' || (s_suppkey % 1000) AS osm, 'N' || max(s_suppkey) AS name FROM supplier GROUP BY s_suppkey % 1000")
def src_landmark_models(spark, d):
    recipes = F.array(*map(F.lit, S.RECIPES))
    m = fixture(spark, d, "supplier").select(
        F.col("s_suppkey").alias("pos"), F.concat(F.lit("way/"), F.col("s_suppkey") % 1000).alias("osm"), F.concat(F.lit("N"), "s_suppkey").alias("name"), F.get(recipes, (F.col("s_suppkey") % 7).cast("int")).alias("recipe"),
        F.array(F.concat(F.lit("way/"), F.col("s_suppkey") + 100)).alias("supersedes"), F.create_map(F.lit("eaves_m"), F.lit("9")).alias("params"),
    )
    return S.load_models(m)[0].select("osm", "name")


@register(f"SELECT layer, count(*) AS n FROM ({_selector_sql()}) GROUP BY layer")
def snk_layers(spark, d):
    path = _path(spark, "layers")
    hits = B.layer_selectors(_elements(spark, d), _BBOX)
    S.write_layers({n: hits.where(F.col("layer") == n).drop("layer") for n in B.LAYERS}, path)
    return spark.read.parquet(path).groupBy(F.col("layer").cast("string").alias("layer")).agg(F.count("*").alias("n"))
