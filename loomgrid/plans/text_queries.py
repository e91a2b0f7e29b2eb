"""Registered queries over scripts, responses and templates, with DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import text as T
from loomgrid.operators import scripts as S
from loomgrid.operators import templates as M
from loomgrid.plans.fixtures import fixture
from loomgrid.sources.tables import shared_folder

_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_LINES = f"""lines AS (SELECT script_id, CAST(i - 1 AS BIGINT) AS line_index, {_STRIP.format('l')} AS line
  FROM (SELECT script_id, unnest(a) AS l, generate_subscripts(a, 1) AS i FROM (SELECT script_id, string_split({_STRIP.format('raw')}, chr(10)) AS a FROM fx_scripts)) WHERE {_STRIP.format('l')} <> '')"""
_MARK = r"'^[\[\(]?(\d{1,2}:\d{2}(?::\d{2})?)[\]\)]?\s*[-–—]?\s*(.*)'"
_CRIT = "crit AS (SELECT *, (s1 + s2 + s3 + s4) / 4.0 AS overall FROM fx_critiqued)"
_CAND = _CRIT + """, cand AS (SELECT script_id, line_index, pos, NOT (passes AND overall >= 3.0) AND has_alt AS is_alternative,
  CASE WHEN NOT (passes AND overall >= 3.0) AND has_alt THEN 3.0 ELSE overall END AS score FROM crit),
  best AS (SELECT *, min(pos) OVER (PARTITION BY script_id, line_index) AS first_pos, row_number() OVER (PARTITION BY script_id, line_index ORDER BY score DESC, pos) AS n FROM cand)"""  # fmt: skip

QUERIES, ORACLE = {}, {}


def register(sql: str | None = None):
    """Register the query under its function's name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return S.script_lines(fixture(spark, d, "fx_scripts"))


def _critiqued(spark: SparkSession, d: str) -> DataFrame:
    return S.critique_score(fixture(spark, d, "fx_critiqued"))


def _templates(spark: SparkSession, d: str) -> DataFrame:
    t = fixture(spark, d, "fx_templates")
    return t.select("tpl_pos", "name", F.array("emotion_a", "emotion_b").alias("emotions"), F.array("tag_a", "tag_b").alias("tags"))


@register(f"WITH {_LINES} SELECT * FROM lines")
def script_lines(spark, d):
    return _lines(spark, d)


@register(f"""WITH t AS (SELECT script_id, line_index, {_STRIP.format('raw_line')} AS l FROM fx_timed_lines),
  p AS (SELECT script_id, line_index, nullif(regexp_extract(l, {_MARK}, 1), '') AS ts, CASE WHEN regexp_matches(l, {_MARK}) THEN {_STRIP.format(f"regexp_extract(l, {_MARK}, 2)")} ELSE l END AS text FROM t)
  SELECT * FROM p WHERE text <> ''""")
def line_timestamps(spark, d):
    return S.line_timestamps(fixture(spark, d, "fx_timed_lines"), "raw_line")


@register(f"WITH {_LINES} SELECT script_id, string_agg(line_index || ': ' || line, chr(10) ORDER BY line_index) AS script FROM lines GROUP BY script_id")
def script_concat(spark, d):
    return S.script_concat(S.line_timestamps(_lines(spark, d)))


@register(f"""WITH {_LINES}, n AS (SELECT script_id, count(*) AS n FROM lines GROUP BY script_id), m AS (SELECT script_id, line_index AS pos, (length(line) * 37 + line_index) % 101 / 100.0 AS confidence FROM lines),
  r AS (SELECT m.*, row_number() OVER (PARTITION BY m.script_id ORDER BY confidence DESC, pos) AS place, n.n FROM m JOIN n USING (script_id))
  SELECT script_id, pos, CAST(confidence AS DOUBLE) AS confidence, CAST(place AS INTEGER) AS place FROM r WHERE place <= greatest(2, n // 5)""")
def density_cap(spark, d):
    lines = _lines(spark, d)
    moments = lines.select("script_id", F.col("line_index").alias("pos"), ((F.length("line") * 37 + F.col("line_index")) % 101 / F.lit(100.0)).alias("confidence"))
    return S.density_cap(moments, lines.groupBy("script_id").agg(F.count("*").alias("n_lines")))


def _wrapped(spark, d):
    """Critique responses in five wrappings: bare, two fences, prose around, broken."""
    c = fixture(spark, d, "fx_critiqued")
    body = F.format_string('{"surprise_score": %d, "relevance_score": "%d", "timing_score": %d.9, "passes_layer_test": "%s", "alternative": %s}', "s1", "s2", "s3", F.col("passes").cast("string"), F.when(F.col("has_alt"), F.lit('{"template_name": "alt"}')).otherwise(F.lit("{}")))
    text = F.when(F.col("pos") % 5 == 0, body).when(F.col("pos") % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("pos") % 5 == 2, F.concat(F.lit("Well:\n```\n"), body, F.lit("\n```"))).when(F.col("pos") % 5 == 3, F.concat(F.lit("I think "), body, F.lit(" is fair."))).otherwise(F.concat(F.lit("no: "), F.substring(body, 1, 30)))
    return c.select(F.col("pos").alias("suggestion_id"), T.json_response(text).alias("response"))


@register("""SELECT pos AS suggestion_id, CASE WHEN pos % 5 <> 4 THEN '{"alternative":' || CASE WHEN has_alt THEN '{"template_name":"alt"}' ELSE '{}' END || ',"passes_layer_test":"' || CAST(passes AS VARCHAR) || '","relevance_score":"' || s2 || '","surprise_score":' || s1 || ',"timing_score":' || s3 || '.9}' END AS value FROM fx_critiqued""")
def json_response(spark, d):
    return _wrapped(spark, d).select("suggestion_id", F.to_json("response").alias("value"))


@register("""SELECT pos AS suggestion_id, CASE WHEN pos % 5 = 4 THEN 3 ELSE s1 END AS s1, CASE WHEN pos % 5 = 4 THEN 3 ELSE s2 END AS s2, CASE WHEN pos % 5 = 4 THEN 3 ELSE s3 END AS s3, CAST(3 AS BIGINT) AS s4, true AS passes,
  CASE WHEN pos % 5 = 4 THEN 3.0 ELSE (s1 + s2 + s3 + 3) / 4.0 END AS overall, CASE WHEN pos % 5 <> 4 AND has_alt THEN 'alt' END AS alternative FROM fx_critiqued""")
def critique_coerce(spark, d):
    return S.critique_coerce(_wrapped(spark, d))


@register("""SELECT pos AS moment_pos, CAST(k AS BIGINT) AS pos, 'L' || k AS line, CAST(CASE k WHEN 0 THEN s1 ELSE 0 END AS BIGINT) AS line_index, CASE k WHEN 0 THEN 'pun' ELSE 'irony' END AS comedy_mechanism, 'frustration' AS emotional_beat,
  CAST(CASE k WHEN 0 THEN s2 / 10.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM fx_critiqued CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) t""")
def moments_valid(spark, d):
    c = fixture(spark, d, "fx_critiqued")
    text = F.format_string('[{"line": "L0", "line_index": %d, "comedy_mechanism": "pun", "confidence": "0.%d"}, {"line": "L1"}, {"line": "L2", "confidence": null}, {"text": "no line"}]', "s1", "s2")
    out = S.moments_valid(c.select(F.col("pos").alias("script_id"), F.parse_json(text).alias("response")))
    return out.select(F.col("script_id").alias("moment_pos"), "pos", "line", "line_index", "comedy_mechanism", "emotional_beat", "confidence")


@register("""SELECT pos AS moment_id, CAST(k AS BIGINT) AS pos, 'T' || k AS template_name, CASE k WHEN 0 THEN s1 ELSE CAST(2 AS BIGINT) END AS rank, k = 0 AS modification_needed, CAST(CASE k WHEN 0 THEN 1 ELSE 0 END AS INTEGER) AS n_captions
  FROM fx_critiqued CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 2) t""")
def suggestions_valid(spark, d):
    c = fixture(spark, d, "fx_critiqued")
    text = F.format_string('[{"template_name": "T0", "rank": %d, "modification_needed": "false", "captions": {"a": "b"}}, {"captions": {}}, {"template_name": "T2"}]', "s1")
    out = S.suggestions_valid(c.select(F.col("pos").alias("moment_id"), F.parse_json(text).alias("response")))
    return out.select("moment_id", "pos", "template_name", "rank", "modification_needed", F.size("captions").alias("n_captions"))


@register("SELECT script_id, line_index, pos, s1 AS rank, row_number() OVER (PARTITION BY script_id, line_index ORDER BY s1, pos) AS place FROM fx_critiqued")
def rank_order(spark, d):
    return S.rank_order(fixture(spark, d, "fx_critiqued").select("script_id", "line_index", "pos", F.col("s1").alias("rank")))


@register(f"WITH {_CRIT} SELECT script_id, pos, CAST(overall AS DOUBLE) AS overall FROM crit")
def critique_score(spark, d):
    return _critiqued(spark, d).select("script_id", "pos", "overall")


@register(f"WITH {_CRIT} SELECT script_id, pos, passes AND overall >= 3.0 AS good FROM crit")
def good_enough(spark, d):
    return _critiqued(spark, d).select("script_id", "pos", S.good_enough(F.col("passes"), F.col("overall")).alias("good"))


@register(f"WITH {_CAND} SELECT script_id, line_index, first_pos, pos, is_alternative, CAST(score AS DOUBLE) AS score FROM best WHERE n = 1 AND score >= 3.0")
def best_per_moment(spark, d):
    return S.best_per_moment(_critiqued(spark, d))


@register(f"WITH {_CAND} SELECT script_id, b.pos, is_alternative, CASE WHEN NOT is_alternative THEN CAST(score AS DOUBLE) END AS critique_overall FROM best b WHERE n = 1 AND score >= 3.0")
def attach_critique(spark, d):
    c = _critiqued(spark, d)
    return S.attach_critique(S.best_per_moment(c), c).select("script_id", "pos", "is_alternative", "critique_overall")


@register(f"""WITH {_CAND}, o AS (SELECT script_id, pos, row_number() OVER (PARTITION BY script_id ORDER BY first_pos) - 1 AS k FROM best WHERE n = 1 AND score >= 3.0)
  SELECT script_id, pos, 'meme_' || lpad(k::VARCHAR, 3, '0') || '_its_the_same_picture_' || pos || '.png' AS file_name FROM o""")
def output_name(spark, d):
    out = S.best_per_moment(_critiqued(spark, d)).withColumn("template_name", F.concat(F.lit("It's the Same-Picture! "), "pos"))
    return S.output_name(out).select("script_id", "pos", "file_name")


@register(f"""WITH {_CAND}, o AS (SELECT script_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY first_pos, pos) AS memes FROM best WHERE n = 1 AND score >= 3.0 GROUP BY script_id),
  m AS (SELECT script_id, count(DISTINCT line_index) AS k, count(*) AS c FROM crit GROUP BY script_id)
  SELECT script_id, 'strict' AS density, k AS total_moments_detected, c AS total_suggestions_generated, coalesce(o.n, 0) AS total_memes_output, coalesce(memes, '') AS memes FROM m LEFT JOIN o USING (script_id)""")
def snk_manifest(spark, d):
    c = _critiqued(spark, d)
    out = S.manifests({"density": "strict", "quality_threshold": "3.0"}, c.select("script_id", "line_index").distinct(), c, S.best_per_moment(c))
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    out.write.json(path)  # a manifest a row
    kept = spark.read.schema("script_id long, config map<string,string>, total_moments_detected long, total_suggestions_generated long, total_memes_output long, memes array<struct<pos:long>>").json(path)
    memes = F.array_join(F.transform("memes", lambda m: m["pos"].cast("string")), ",")
    return kept.select("script_id", F.col("config")["density"].alias("density"), "total_moments_detected", "total_suggestions_generated", "total_memes_output", memes.alias("memes"))


@register("SELECT q_id, coalesce((SELECT max(tpl_pos) FROM fx_templates WHERE lower(name) = lower(q)), CAST(-1 AS BIGINT)) AS tpl_pos FROM fx_names")
def tpl_by_name(spark, d):
    return M.tpl_by_name(fixture(spark, d, "fx_names"), _templates(spark, d)).withColumn("tpl_pos", F.coalesce("tpl_pos", F.lit(-1).cast("long")))


@register("""WITH a AS (SELECT DISTINCT lower(q) AS low FROM fx_names), t AS (SELECT tpl_pos, lower(name) AS t FROM fx_templates),
  e AS (SELECT low, max(tpl_pos) AS tpl_pos, 1 AS tier FROM a JOIN t ON low = t GROUP BY low), h AS (SELECT low, min(tpl_pos) AS tpl_pos, 2 AS tier FROM a JOIN t ON contains(low, t) OR contains(t, low) WHERE low NOT IN (SELECT low FROM e) GROUP BY low),
  w AS (SELECT low, tpl_pos, len(list_intersect(list_distinct(string_split(low, ' ')), list_distinct(string_split(t, ' ')))) AS n FROM a, t WHERE low NOT IN (SELECT low FROM e) AND low NOT IN (SELECT low FROM h)),
  b AS (SELECT low, tpl_pos, 3 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY n DESC, tpl_pos) AS r FROM w WHERE n > 0) WHERE r = 1), f AS (SELECT * FROM e UNION ALL SELECT * FROM h UNION ALL SELECT * FROM b)
  SELECT q_id, coalesce(tpl_pos, CAST(-1 AS BIGINT)) AS tpl_pos, coalesce(tier, 0) AS tier FROM fx_names LEFT JOIN f ON lower(q) = low""")
def tpl_fuzzy(spark, d):
    return M.tpl_fuzzy(fixture(spark, d, "fx_names"), _templates(spark, d)).select("q_id", F.coalesce("tpl_pos", F.lit(-1).cast("long")).alias("tpl_pos"), F.coalesce("tier", F.lit(0)).alias("tier"))


@register("""WITH b AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS beat FROM part UNION SELECT 'nothing like it'), h AS (SELECT beat, tpl_pos FROM b JOIN fx_templates ON contains(emotion_a, beat) OR contains(emotion_b, beat)),
  n AS (SELECT beat FROM h GROUP BY beat HAVING count(*) >= 3) SELECT * FROM h WHERE beat IN (SELECT beat FROM n) UNION ALL SELECT b.beat, tpl_pos FROM b, fx_templates WHERE b.beat NOT IN (SELECT beat FROM n)""")
def tpl_by_emotion(spark, d):
    beats = fixture(spark, d, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("beat")).distinct().union(spark.range(1).select(F.lit("Nothing like it")))
    return M.tpl_by_emotion(beats, _templates(spark, d))


@register("WITH w AS (SELECT lower(p_brand) AS tag FROM part WHERE p_size < 3) SELECT tpl_pos, name FROM fx_templates WHERE tag_a IN (SELECT tag FROM w) OR tag_b IN (SELECT tag FROM w)")
def tpl_by_tags(spark, d):
    wanted = fixture(spark, d, "part").where("p_size < 3").select(F.upper("p_brand").alias("tag"))
    return M.tpl_by_tags(wanted, _templates(spark, d)).select("tpl_pos", "name")


@register("""SELECT tpl_pos, '- Name: ' || name || chr(10) || '  Format: top_bottom' || chr(10) || '  Structure: ' || tag_a || chr(10) || '  Emotional register: ' || emotion_a || ', ' || emotion_b || chr(10) ||
  '  Customizable text regions: ["' || tag_a || '", "' || tag_b || '"]' || chr(10) || '  Typical uses: a, b, c' AS block FROM fx_templates""")
def tpl_describe(spark, d):
    t = _templates(spark, d)
    uses = F.array(*map(F.lit, "abcd"))
    return M.tpl_describe(t.select("tpl_pos", "name", F.lit("top_bottom").alias("format"), F.element_at("tags", 1).alias("humor_convention"), "emotions", F.col("tags").alias("labels"), uses.alias("typical_uses")))


@register("SELECT p_partkey, len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), list_distinct(string_split(lower(p_type || ' ' || p_name), ' ')))) AS shared FROM part")
def word_overlap(spark, d):
    return fixture(spark, d, "part").select("p_partkey", M.word_overlap(F.col("p_name"), F.concat("p_type", F.lit(" "), "p_name")).cast("long").alias("shared"))


@register("""SELECT pos AS suggestion_id, CASE WHEN s1 > 2 AND s2 > 1 THEN 'new' ELSE 'old' END AS caption, CASE WHEN s1 > 2 AND s2 > 1 AND s3 > 2 THEN 'why' ELSE 'because' END AS reasoning FROM fx_critiqued""")
def refine_captions(spark, d):
    c = fixture(spark, d, "fx_critiqued").withColumnRenamed("pos", "suggestion_id")
    told = c.select("suggestion_id", F.create_map(F.lit("top"), F.lit("old")).alias("captions"), F.lit("because").alias("reasoning"), F.when(F.col("s1") > 2, F.col("s1")).alias("tpl_pos"))
    new = c.select("suggestion_id", F.when(F.col("s2") > 1, F.create_map(F.lit("top"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>")).alias("captions"), F.when(F.col("s3") > 2, F.lit("why")).alias("reasoning"))
    return M.refine_captions(told, new).select("suggestion_id", F.col("captions")["top"].alias("caption"), "reasoning")


@register("SELECT p_partkey, CAST(least(5.0, greatest(2.0, (length(p_name) + length(p_type)) / 15.0)) AS DECIMAL(8, 4))::DOUBLE AS secs FROM part")
def display_secs(spark, d):
    return fixture(spark, d, "part").select("p_partkey", F.round(T.display_secs(F.create_map(F.lit("a"), "p_name", F.lit("b"), "p_type")), 4).alias("secs"))


@register(r"SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name || '''s -- ' || p_type || '!'), '[^\w\s-]', '', 'g'), '[\s_-]+', '_', 'g'), 1, 50) AS slug FROM part")
def slugify(spark, d):
    return fixture(spark, d, "part").select("p_partkey", T.slugify(F.concat(F.lit("  "), "p_name", F.lit("'s -- "), "p_type", F.lit("! "))).alias("slug"))


@register("""SELECT pos, CAST(i AS INTEGER) AS i, 'k' || i AS label, CAST(CASE WHEN s1 = 1 THEN 400 WHEN i = 0 THEN 20 WHEN i = 1 THEN 320 ELSE least(20 + 200 * i, 500) END AS INTEGER) AS y, CAST(CASE WHEN s1 >= 2 AND i < 2 THEN 260 ELSE 180 END AS INTEGER) AS height,
  CAST(CASE WHEN i < 2 THEN 36 ELSE 30 END AS INTEGER) AS font_size FROM fx_critiqued CROSS JOIN range(5) r(i) WHERE i < s1""")
def generic_regions(spark, d):
    c = fixture(spark, d, "fx_critiqued")
    captions = F.transform(F.sequence(F.lit(0), F.col("s1").cast("int") - 1), lambda i: F.struct(F.concat(F.lit("k"), i.cast("string")).alias("key"), F.lit("v").alias("value")))
    return c.select("pos", F.posexplode(M.generic_regions(captions)).alias("i", "r")).select("pos", "i", "r.label", "r.y", "r.height", "r.font_size")


@register(r"""WITH RECURSIVE w AS (SELECT p_partkey AS key, string_split(upper(p_name || ' ' || p_type), ' ') AS ws FROM part), f(key, ws, i, line_no, line) AS (SELECT key, ws, 1, 0, ws[1] FROM w UNION ALL
  SELECT key, ws, i + 1, CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 16 THEN line_no ELSE line_no + 1 END, CASE WHEN length(line) + 1 + length(ws[i + 1]) <= 16 THEN line || ' ' || ws[i + 1] ELSE ws[i + 1] END FROM f WHERE i < len(ws)),
  l AS (SELECT key, line_no, arg_max(line, i) AS line FROM f GROUP BY key, line_no), n AS (SELECT key, count(*) AS n FROM l GROUP BY key)
  SELECT key, CAST(line_no AS INTEGER) AS line_no, line, CAST(20 + floor((256 - length(line) * 16) / 2) AS INTEGER) AS line_x, CAST(greatest(10, 10 + floor((120 - 36 * n) / 2)) + line_no * 36 AS INTEGER) AS line_y FROM l JOIN n USING (key)""")
def caption_layout(spark, d):
    p = fixture(spark, d, "part").select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(" "), "p_type").alias("text"))
    return M.caption_layout(p.withColumns({"x": F.lit(20), "y": F.lit(10), "width": F.lit(256), "height": F.lit(120), "font_size": F.lit(32), "align": F.lit("center")}))


@register("""SELECT pos AS suggestion_id, 'Rate T' || s1 || ' with {"top":"x' || s2 || '"} for this line: ' || line_index AS prompt FROM fx_critiqued""")
def render_prompts(spark, d):
    c = fixture(spark, d, "fx_critiqued")
    rows = c.select(F.col("pos").alias("suggestion_id"), F.concat(F.lit("T"), "s1").alias("template_name"), F.to_json(F.create_map(F.lit("top"), F.concat(F.lit("x"), "s2"))).alias("captions"), F.col("line_index").alias("line"))
    return S.render_prompts(rows, "critique", "suggestion_id")


@register("""SELECT pos AS suggestion_id, CASE WHEN s1 <> 3 THEN '{"surprise_score": ' || s1 || '}' END AS response, CASE WHEN s1 = 3 THEN 'no answer' END AS error FROM fx_critiqued""")
def batch_infer(spark, d):
    def stub(prompt: str) -> str:
        if prompt == "3":
            raise ValueError("no answer")
        return f'{{"surprise_score": {prompt}}}'

    c = fixture(spark, d, "fx_critiqued").select(F.col("pos").alias("suggestion_id"), F.col("s1").cast("string").alias("prompt"))
    return S.batch_infer(c, "suggestion_id", stub)
