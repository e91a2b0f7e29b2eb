"""Free-text names against a catalogue of templates, and captions laid out in their regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.sources.tables import stored

#: A catalogue above this many rows is joined by shuffling instead of being sent to every executor.
SMALL_CATALOGUE = 20_000
#: Up to so many distinct pieces of three characters are sent to every executor; a piece in more texts than FREQUENT is salted.
MANY_PIECES, FREQUENT, SALTS = 500_000, 1000, 16


def small(templates: DataFrame, most: int | None = None) -> DataFrame:
    """The catalogue with a broadcast hint if it is counted to be small."""
    most = SMALL_CATALOGUE if most is None else most
    return F.broadcast(templates) if templates.limit(most + 1).count() <= most else templates


def tpl_by_name(names: DataFrame, templates: DataFrame) -> DataFrame:
    """q_id, tpl_pos: the template with the name, case aside; of equal names the last."""
    last = templates.groupBy(F.lower("name").alias("low")).agg(F.max("tpl_pos").alias("tpl_pos"))
    return names.withColumn("low", F.lower("q")).join(small(last), "low", "left").select("q_id", "tpl_pos")


def _grams(text: Column, size: int = 3) -> Column:
    """All distinct pieces of one to `size` characters."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*[cut(n) for n in range(1, size + 1)])))


def _pieces(text: Column, n: int) -> Column:
    """The distinct pieces of n characters of a text; a shorter text is one piece."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - n + 1)), lambda i: F.substring(text, i, F.lit(n))))


def rarest_pieces(short: DataFrame, long: DataFrame, a: str, b: str, size: int = 3) -> DataFrame:
    """Rows of `short` with the piece of theirs that the fewest texts of `long` have, and their number: _g, _df.

    A text with a piece that no text of `long` has is in none of them, and goes. A frequent piece has as many copies of its
    count as there are salts, so texts that share one are not counted by one task.
    """
    held = long.select(F.explode(_grams(F.col(b), size)).alias("_g")).groupBy("_g").agg(F.count("*").alias("_df"))
    asked = short.where(F.length(a) > 0).select(F.col(a).alias("_t")).distinct().select("_t", F.explode(_pieces(F.col("_t"), size)).alias("_g"))
    salt = F.pmod(F.xxhash64("_t"), F.lit(SALTS)).cast("int")
    copies = F.when(F.col("_df") > FREQUENT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    # a rare piece has one copy, under the salt -1; a frequent one is met under the text's own
    counted = held.withColumn("_s", F.explode(copies))
    met = asked.withColumn("_s", F.explode(F.array(F.lit(-1), salt))).join(counted, ["_g", "_s"])
    best = met.groupBy("_t").agg(F.min(F.struct("_df", "_g")).alias("m"), F.count("*").alias("_n"))
    pieces = F.size(_pieces(F.col("_t"), size))
    chosen = best.where(F.col("_n") == pieces).select("_t", F.col("m._g").alias("_g"), F.col("m._df").alias("_df"))
    return short.join(chosen, short[a] == chosen["_t"]).drop("_t")


def held_in(short: DataFrame, long: DataFrame, a: str, b: str, size: int = 3) -> DataFrame:
    """All rows of `short` (column a) with all rows of `long` (column b) that contain them: an inverted index of pieces.

    Each text of `short` probes the postings of its rarest piece only, then containment is verified. Postings of pieces that no
    text probes are not shuffled if the probed ones are counted to be few. A text of fewer than `size` characters is its own
    piece; the empty text is in every text and is left to the caller. Nulls are in nothing, and hold nothing.
    """
    keys = stored(rarest_pieces(short, long, a, b, size).drop("_df"), "keys")
    probed = small(keys.select("_g").distinct(), MANY_PIECES)
    postings = long.withColumn("_g", F.explode(_grams(F.col(b), size))).join(probed, "_g", "left_semi")
    return keys.join(postings, "_g").where(F.contains(b, a)).drop("_g")


def tpl_fuzzy(names: DataFrame, templates: DataFrame) -> DataFrame:
    """q_id, tpl_pos, tier: exact, else the first template of which one name holds the other, else the largest overlap of words.

    Each distinct name is matched once: exact names and words by equality, containment by equality of a few characters that
    is then verified. The empty name is in the first template, and a template of the empty name in all names.
    """
    asked = names.select(F.lower("q").alias("low")).distinct()
    listed = templates.select("tpl_pos", F.lower("name").alias("t"))
    exact = asked.join(small(listed.groupBy("t").agg(F.max("tpl_pos").alias("tpl_pos"))), F.col("low") == F.col("t")).select("low", "tpl_pos", F.lit(1).alias("tier"))
    rest = asked.join(exact, "low", "left_anti")
    first = listed.groupBy("t").agg(F.min("tpl_pos").alias("tpl_pos"))
    found = held_in(first, rest, "t", "low").select("low", "tpl_pos").unionByName(held_in(rest, first, "low", "t").select("low", "tpl_pos"))
    ends = listed.agg(F.min("tpl_pos").alias("any"), F.min(F.when(F.col("t") == "", F.col("tpl_pos"))).alias("blank"))
    found = found.unionByName(rest.crossJoin(F.broadcast(ends)).select("low", F.when(F.col("low") == "", F.col("any")).otherwise(F.col("blank")).alias("tpl_pos")).where("tpl_pos IS NOT NULL"))  # one row
    held = found.groupBy("low").agg(F.min("tpl_pos").alias("tpl_pos")).withColumn("tier", F.lit(2))
    left = rest.join(held, "low", "left_anti")
    words = lambda c: F.array_distinct(F.split(c, r"\s+"))
    meet = left.select("low", F.explode(words("low")).alias("w")).join(small(listed.select("tpl_pos", F.explode(words("t")).alias("w"))), "w").groupBy("low", "tpl_pos").count()
    most = meet.groupBy("low").agg(F.min_by("tpl_pos", F.struct(-F.col("count"), F.col("tpl_pos"))).alias("tpl_pos")).withColumn("tier", F.lit(3))
    found = exact.unionByName(held).unionByName(most)
    return names.withColumn("low", F.lower("q")).join(found, "low", "left").select("q_id", "tpl_pos", "tier")


def tpl_by_emotion(beats: DataFrame, templates: DataFrame, least: int = 3) -> DataFrame:
    """beat, tpl_pos: templates with an emotion that contains the beat; all of them where fewer than `least` do, as asked for.

    The empty beat is in every emotion.
    """
    asked = beats.select(F.lower("beat").alias("beat")).distinct()
    felt = templates.select("tpl_pos", F.explode("emotions").alias("e")).select("tpl_pos", F.lower("e").alias("e"))
    kinds = felt.select("e").distinct()
    hits = held_in(asked, kinds, "beat", "e").join(felt, "e").select("beat", "tpl_pos").distinct()
    enough = hits.groupBy("beat").count().where(F.col("count") >= least).select("beat")
    some = hits.join(enough, "beat", "left_semi")
    # the result has every template for each of these beats, so it is as large as this join
    return some.unionByName(asked.join(enough, "beat", "left_anti").crossJoin(small(templates.select("tpl_pos"))))


def tpl_by_tags(wanted: DataFrame, templates: DataFrame) -> DataFrame:
    """Templates (tpl_pos, tags) that share a tag with wanted (tag), case aside."""
    tags = wanted.select(F.lower("tag").alias("tag")).distinct()
    matching = templates.select("tpl_pos", F.explode("tags").alias("tag")).withColumn("tag", F.lower("tag")).join(tags, "tag", "left_semi").select("tpl_pos").distinct()
    return templates.join(matching, "tpl_pos", "left_semi")


def tpl_describe(templates: DataFrame) -> DataFrame:
    """tpl_pos and a block of text for a prompt."""
    block = F.concat(
        F.lit("- Name: "), "name", F.lit("\n  Format: "), "format", F.lit("\n  Structure: "), "humor_convention", F.lit("\n  Emotional register: "), F.array_join("emotions", ", "),
        F.lit("\n  Customizable text regions: ["), F.array_join(F.transform("labels", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]\n  Typical uses: "), F.array_join(F.slice("typical_uses", 1, 3), ", "),
    )
    return templates.select("tpl_pos", block.alias("block"))


def word_overlap(a: Column, b: Column) -> Column:
    """How many distinct words two texts share, case aside."""
    return F.size(F.array_intersect(F.split(F.lower(a), r"\s+"), F.split(F.lower(b), r"\s+")))


def refine_captions(suggestions: DataFrame, refined: DataFrame) -> DataFrame:
    """Captions and reasoning of the response where a template matched and the response has captions; else as they were."""
    r = refined.select("suggestion_id", F.col("captions").alias("new_captions"), F.col("reasoning").alias("new_reasoning"))
    use = F.col("tpl_pos").isNotNull() & F.coalesce(F.size("new_captions") > 0, F.lit(False))
    joined = suggestions.join(r, "suggestion_id", "left")
    return joined.select(
        *[c for c in suggestions.columns if c not in ("captions", "reasoning")],
        F.when(use, F.col("new_captions")).otherwise(F.col("captions")).alias("captions"),
        F.when(use, F.coalesce("new_reasoning", "reasoning")).otherwise(F.col("reasoning")).alias("reasoning"),
    )


def generic_regions(captions: Column) -> Column:
    """Boxes for the captions (array of (key, value)) of a suggestion without a template."""

    def box(i: Column, key: Column) -> Column:
        n = F.size(captions)
        y = F.when(n == 1, 400).when(i == 0, 20).when(i == 1, 320).otherwise(F.least(20 + 200 * i, F.lit(500)))
        return F.struct(
            key.alias("label"), F.lit(20).alias("x"), y.cast("int").alias("y"), F.lit(760).alias("width"),
            F.when((n >= 2) & (i < 2), 260).otherwise(180).alias("height"), F.when(i < 2, 36).otherwise(30).alias("font_size"),
        )

    return F.transform(captions, lambda c, i: box(i, c["key"]))


def wrap(text: Column, width: Column) -> Column:
    """Greedy lines of at most `width` characters; longer words are broken."""
    chunks = F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / width).cast("int")), lambda k: F.substring(w, k * width + 1, width))))
    empty = F.array().cast("array<string>")

    def add(lines: Column, w: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        fits = F.size(lines).cast("boolean") & (F.length(last) + 1 + F.length(w) <= width)
        return F.when(fits, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.concat(lines, F.array(w)))

    return F.aggregate(chunks, empty, add)


def caption_layout(placed: DataFrame) -> DataFrame:
    """placed (key, text, x, y, width, height, font_size, align) -> a row for each wrapped line with its place."""
    half = F.greatest(F.lit(1), F.floor(F.col("font_size") / 2).cast("int"))
    wide = F.greatest(F.lit(1), F.floor(F.col("width") / half).cast("int"))
    lined = placed.withColumn("half", half).withColumn("lines", wrap(F.upper("text"), wide)).withColumn("step", F.col("font_size") + 4)
    top = F.greatest(F.col("y"), F.col("y") + F.floor((F.col("height") - F.col("step") * F.size("lines")) / 2).cast("int"))
    rows = lined.withColumn("top", top).select("*", F.posexplode("lines").alias("line_no", "line"))
    length = F.length("line") * F.col("half")
    x = F.when(F.col("align") == "center", F.col("x") + F.floor((F.col("width") - length) / 2).cast("int")).when(F.col("align") == "right", F.col("x") + F.col("width") - length).otherwise(F.col("x"))
    return rows.select("key", "line_no", "line", x.alias("line_x"), (F.col("top") + F.col("line_no") * F.col("step")).alias("line_y"))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
