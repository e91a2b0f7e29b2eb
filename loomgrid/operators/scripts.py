"""Scripts to lines, responses to moments, suggestions and critiques, and the best suggestion of each moment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import text as T

#: How many moments of n lines a script keeps, as (least, lines for each).
DENSITIES = {"sparse": (1, 10), "moderate": (2, 5), "dense": (3, 2)}
NEUTRAL = 3.0


def script_lines(scripts: DataFrame) -> DataFrame:
    """script_id, line_index, line: the lines of raw that are not blank, numbered with the blank ones."""
    rows = scripts.select("script_id", F.posexplode(T.lines(F.col("raw"))).alias("line_index", "line"))
    return rows.select("script_id", F.col("line_index").cast("long"), T.strip(F.col("line")).alias("line")).where("line <> ''")


def line_timestamps(lines: DataFrame, column: str = "line") -> DataFrame:
    """Part each line into its time mark ts (null if none) and text; lines that are only a time mark go."""
    line = T.strip(F.col(column))
    return lines.select("script_id", "line_index", T.time_mark(line).alias("ts"), T.spoken(line).alias("text")).where("text <> ''")


def script_concat(lines: DataFrame) -> DataFrame:
    """One text a script: `index: [ts] text` lines in order."""
    row = F.concat(F.col("line_index").cast("string"), F.lit(": "), F.coalesce(F.concat(F.lit("["), "ts", F.lit("] ")), F.lit("")), "text")
    packed = lines.groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct("line_index", row.alias("row")))).alias("rows"))
    return packed.select("script_id", F.array_join(F.transform("rows", lambda r: r["row"]), "\n").alias("script"))


def density_cap(moments: DataFrame, line_counts: DataFrame, density: str = "moderate") -> DataFrame:
    """The most confident moments of each script, in that order: at most one for so many lines of the script."""
    least, each = DENSITIES[density]
    cap = F.greatest(F.lit(least), F.floor(F.col("n_lines") / each))
    place = F.row_number().over(Window.partitionBy("script_id").orderBy(F.desc("confidence"), "pos"))
    return moments.join(line_counts, "script_id").withColumn("place", place).where(F.col("place") <= cap).drop("n_lines")


def _field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _or(v: Column, name: str, default: str) -> Column:
    return F.coalesce(_field(v, name, "string"), F.lit(default))


def _items(response: Column) -> Column:
    """The elements of a JSON list; a single object is a list of one."""
    as_list = F.try_variant_get(response, "$", "array<variant>")
    return F.when(F.schema_of_variant(response).startswith("OBJECT"), F.array(response)).otherwise(as_list)


def moments_valid(responses: DataFrame) -> DataFrame:
    """responses (script_id, response VARIANT) -> moments, one a well-formed object, in order.

    `line` must be there; `confidence` may be a number in a text, is 0.5 where it is missing, and makes the row malformed
    where it is null or no number.
    """
    each = responses.select("script_id", F.posexplode(_items(F.col("response"))).alias("pos", "m"))
    m = F.col("m")
    given = _field(m, "confidence", "variant")
    number = F.when(given.isNull(), F.lit(0.5)).otherwise(given.cast("string").try_cast("double"))
    index = _field(m, "line_index", "variant")
    out = each.select(
        "script_id", F.col("pos").cast("long"), _field(m, "line", "string").alias("line"),
        F.when(index.isNull(), F.lit(0).cast("long")).otherwise(_field(m, "line_index", "long")).alias("line_index"),
        _or(m, "comedy_mechanism", "irony").alias("comedy_mechanism"), _or(m, "emotional_beat", "frustration").alias("emotional_beat"),
        _or(m, "subtext", "").alias("subtext"), number.alias("confidence"), _or(m, "context_summary", "").alias("context_summary"),
    )
    return out.where("line IS NOT NULL AND confidence IS NOT NULL AND line_index IS NOT NULL")


def suggestions_valid(responses: DataFrame) -> DataFrame:
    """responses (moment_id, response VARIANT) -> suggestions; template_name must be there, a missing rank is the next in line."""
    each = responses.select("moment_id", F.posexplode(_items(F.col("response"))).alias("pos", "s"))
    s = F.col("s")
    rank = _field(s, "rank", "variant")
    out = each.select(
        "moment_id", F.col("pos").cast("long"), _field(s, "template_name", "string").alias("template_name"),
        F.coalesce(_field(s, "captions", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("captions"), _or(s, "reasoning", "").alias("reasoning"),
        T.truthy(_field(s, "modification_needed", "variant")).alias("modification_needed"), _field(s, "rank", "long").alias("given"), (rank.isNull() | _field(s, "rank", "long").isNotNull()).alias("ok"),
    ).where("template_name IS NOT NULL AND ok")
    place = F.row_number().over(Window.partitionBy("moment_id").orderBy("pos")).cast("long")
    return out.withColumn("rank", F.coalesce("given", place)).drop("given", "ok")


def rank_order(suggestions: DataFrame) -> DataFrame:
    """Add place: the order of a moment's suggestions by rank, then as they came."""
    return suggestions.withColumn("place", F.row_number().over(Window.partitionBy("script_id", "line_index").orderBy("rank", "pos")).cast("long"))


def critique_score(critiques: DataFrame) -> DataFrame:
    """Add overall: the mean of the four scores, a missing one counting as 3."""
    return critiques.withColumn("overall", sum((F.coalesce(F.col(f"s{k}"), F.lit(3)) for k in (1, 2, 3, 4)), F.lit(0)) / F.lit(4.0))


def good_enough(passes: Column, overall: Column) -> Column:
    """Passes the layer test and scores 3 or more, whatever the configured threshold."""
    return passes & (overall >= NEUTRAL)


def critique_coerce(critiques: DataFrame) -> DataFrame:
    """critiques (suggestion_id, response VARIANT) -> scores, passes, overall, feedback, alternative.

    Numbers may be texts, fractions are cut off; truth is that of a scripting language. Anything that is no object or has a
    score that is no number becomes the neutral critique.
    """
    r = F.col("response")
    names = ["surprise_score", "relevance_score", "timing_score", "freshness_score"]

    def score(name: str) -> Column:
        v = _field(r, name, "variant")
        kind, text = F.schema_of_variant(v), v.cast("string")
        whole = F.when(kind == "STRING", text.try_cast("long")).when(kind == "BOOLEAN", (text == "true").cast("long")).otherwise(text.try_cast("double").cast("long"))
        return F.when(v.isNull(), F.lit(3).cast("long")).otherwise(whole)

    scores = [score(n) for n in names]
    right = F.coalesce(F.schema_of_variant(r).startswith("OBJECT"), F.lit(False))
    for s in scores:
        right = right & s.isNotNull()
    passes = _field(r, "passes_layer_test", "variant")
    alt = _field(r, "alternative", "variant")
    named = F.when(T.truthy(alt), _field(alt, "template_name", "string"))
    out = critiques.withColumn("ok", right)
    return out.select(
        "suggestion_id", *[F.when(F.col("ok"), s).otherwise(F.lit(3).cast("long")).alias(f"s{k}") for k, s in enumerate(scores, 1)],
        F.when(F.col("ok"), F.when(passes.isNull() & ~F.coalesce(F.is_variant_null(passes), F.lit(False)), True).otherwise(T.truthy(passes))).otherwise(True).alias("passes"),
        F.when(F.col("ok"), sum(scores, F.lit(0)) / F.lit(4.0)).otherwise(F.lit(NEUTRAL)).alias("overall"), F.when(F.col("ok"), named).alias("alternative"),
    )


def best_per_moment(critiqued: DataFrame, threshold: float = NEUTRAL) -> DataFrame:
    """critiqued (script_id, line_index, pos, passes, overall, has_alt) -> the best candidate of each moment at or above the threshold.

    A suggestion that is not good enough gives way to its alternative, which scores the threshold. The first of equal
    scores wins. Groups are numbered by their first suggestion.
    """
    swapped = ~good_enough(F.col("passes"), F.col("overall")) & F.col("has_alt")
    scored = critiqued.where("overall IS NOT NULL").select("script_id", "line_index", "pos", swapped.alias("is_alternative"), F.when(swapped, F.lit(threshold)).otherwise(F.col("overall")).alias("score"))
    best = scored.groupBy("script_id", "line_index").agg(F.min("pos").alias("first_pos"), F.max_by(F.struct("pos", "is_alternative", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.where(F.col("b.score") >= threshold).select("script_id", "line_index", "first_pos", "b.*")


def attach_critique(outputs: DataFrame, critiques: DataFrame) -> DataFrame:
    """Each output with its critique; a swapped-in alternative has none."""
    seen = critiques.select("script_id", "pos", F.col("overall").alias("critique_overall"), F.lit(False).alias("is_alternative"))
    return outputs.join(seen, ["script_id", "pos", "is_alternative"], "left")


def output_name(outputs: DataFrame) -> DataFrame:
    """Add file_name from the place in the script's output order and the template's name."""
    place = F.row_number().over(Window.partitionBy("script_id").orderBy("first_pos")) - 1
    return outputs.withColumn("file_name", F.format_string("meme_%03d_%s.png", place, T.slugify(F.col("template_name"))))


def manifest_totals(moments: DataFrame, suggestions: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row of the three counts; suggestions are those that the filter left."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(moments, "total_moments_detected").crossJoin(count(suggestions, "total_suggestions_generated")).crossJoin(count(outputs, "total_memes_composited"))


def manifests(config: dict[str, str], moments: DataFrame, suggestions: DataFrame, outputs: DataFrame) -> DataFrame:
    """One manifest a script: script_id, config, the three totals, and memes, its outputs in the order of first_pos.

    Scripts without outputs have an empty list; those without anything have no row.
    """
    count = lambda df, name: df.groupBy("script_id").agg(F.count("*").alias(name))
    columns = ["first_pos", *[c for c in outputs.columns if c not in ("script_id", "first_pos")]]
    memes = outputs.groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("memes"))
    joined = count(moments, "total_moments_detected").join(count(suggestions, "total_suggestions_generated"), "script_id", "full").join(memes, "script_id", "full")
    settings = F.create_map(*[F.lit(x) for kv in config.items() for x in kv]) if config else F.create_map().cast("map<string,string>")
    none = F.array().cast(memes.schema["memes"].dataType)
    return joined.select(
        "script_id", settings.alias("config"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_moments_detected", "total_suggestions_generated")],
        F.coalesce(F.size("memes"), F.lit(0)).cast("long").alias("total_memes_output"), F.coalesce("memes", none).alias("memes"),
    )


#: Prompt texts of the stages; the fields are columns.
PROMPTS = {
    "analyze": "Find the comic moments of this script ({density}):\n{script}",
    "select": "Choose templates for this moment.\nLine: {line}\nMechanism: {comedy_mechanism}\nBeat: {emotional_beat}\nTemplates:\n{templates}",
    "critique": "Rate {template_name} with {captions} for this line: {line}",
    "refine": "Rewrite the captions {captions} of {template_name}.",
}


def render_prompts(rows: DataFrame, stage: str, key: str) -> DataFrame:
    """key, prompt: the stage's text with each {field} filled from the column of its name."""
    import re

    parts = re.split(r"\{(\w+)\}", PROMPTS[stage])
    filled = [F.lit(p) if k % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for k, p in enumerate(parts)]
    return rows.select(key, F.concat(*filled).alias("prompt"))


def batch_infer(prompts: DataFrame, key: str, score: Callable[[str], str]) -> DataFrame:
    """key, response, error: the scorer's answer to every prompt; what it raises is the row's error, and other rows go on."""

    def run(batches):
        for pdf in batches:
            answers = []
            for prompt in pdf["prompt"]:
                try:
                    answers.append((score(prompt), None))
                except Exception as e:  # noqa: BLE001  the row degrades
                    answers.append((None, str(e)))
            pdf["response"], pdf["error"] = [a for a, _ in answers], [e for _, e in answers]
            yield pdf[[key, "response", "error"]]

    return prompts.mapInPandas(run, f"{key} {dict(prompts.dtypes)[key]}, response string, error string")
