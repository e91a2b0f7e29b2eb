"""Column functions for scripts, responses and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a text is split into lines, and what a time mark at the head of a line looks like.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
TIME_MARK = r"^[\[\(]?(\d{1,2}:\d{2}(?::\d{2})?)[\]\)]?\s*[-–—]?\s*(.*)"


#: Characters of Unicode's White_Space property.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def lines(raw: Column) -> Column:
    """The stripped text's lines, blank ones included."""
    return F.split(strip(raw), LINE_BREAK, -1)


def time_mark(line: Column) -> Column:
    """The time at the head of a line, or null."""
    return F.nullif(F.regexp_extract(line, "(?s)" + TIME_MARK, 1), F.lit(""))


def spoken(line: Column) -> Column:
    """The line without its time mark; a line that is only a time mark gives the empty text."""
    return F.when(line.rlike("(?s)" + TIME_MARK), strip(F.regexp_extract(line, "(?s)" + TIME_MARK, 2))).otherwise(line)


def slugify(text: Column) -> Column:
    """Lower case, word characters joined by single underscores, at most 50 characters."""
    kept = F.regexp_replace(strip(F.lower(text)), r"(?U)[^\w\s-]", "")
    return F.substring(F.regexp_replace(kept, r"(?U)[\s_-]+", "_"), 1, 50)


def display_secs(captions: Column) -> Column:
    """Reading time of a map of captions: 15 characters a second, between 2 and 5 seconds."""
    chars = F.aggregate(F.map_values(captions), F.lit(0), lambda n, v: n + F.length(v))
    return F.least(F.lit(5.0), F.greatest(F.lit(2.0), chars / F.lit(15.0)))


#: Fenced blocks in a response, and how far colours are muted.
FENCES = (r"(?s)```json\s*\n?(.*?)\n?\s*```", r"(?s)```\s*\n?(.*?)\n?\s*```")
MUTE, GREY = 0.82, 128


def json_response(text: Column) -> Column:
    """The JSON value in a response as VARIANT: all of it, a fenced block, or what the outermost brackets hold; else null."""
    t = strip(text)

    def between(a: str, b: str) -> Column:
        start, end = F.instr(t, a), F.length(t) - F.instr(F.reverse(t), b) + 1
        return F.when((start > 0) & (F.instr(t, b) > 0) & (end > start), F.substring(t, start, end - start + 1))

    fenced = [F.when(t.rlike(p), strip(F.regexp_extract(t, p, 1))) for p in FENCES]
    tries = [F.when(t != "", t), *fenced, between("[", "]"), between("{", "}")]
    return F.coalesce(*[F.try_parse_json(x) for x in tries])


def truthy(value: Column) -> Column:
    """Truth of a VARIANT as a scripting language sees it: empty texts, lists, objects, zero, false and null are false."""
    kind, text = F.schema_of_variant(value), value.cast("string")
    return (
        F.when(value.isNull() | F.is_variant_null(value), False)
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY"), text != "[]")
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(F.coalesce(text.try_cast("double") != 0, F.lit(True)))
    )


def muted(channel: Column) -> Column:
    """A colour channel pulled a little toward mid grey."""
    return F.floor(channel * MUTE + GREY * 0.18).cast("int")


#: Colour names that buildings are tagged with.
NAMED_COLOURS = {
    "black": (58, 58, 62), "grey": (128, 128, 130), "gray": (128, 128, 130), "darkgrey": (86, 86, 90), "dark_grey": (86, 86, 90),
    "lightgrey": (168, 168, 170), "white": (232, 232, 228), "brown": (132, 92, 68), "red": (156, 78, 62), "darkred": (124, 60, 48),
    "green": (96, 122, 88), "darkgreen": (74, 96, 68), "blue": (92, 112, 148), "slate": (112, 122, 136), "silver": (176, 178, 180),
    "beige": (208, 194, 168), "orange": (188, 118, 66), "terracotta": (170, 100, 74),
}


def parse_colour(tag: Column) -> Column:
    """#rgb, #rrggbb or a known name as a muted (r, g, b) struct; else null."""
    t = F.lower(strip(tag))
    short = F.regexp_replace(t, "^#(.)(.)(.)$", "#$1$1$2$2$3$3")
    hexed = F.when(short.rlike("^#[0-9a-f]{6}$"), F.array(*[F.conv(F.substring(short, k, 2), 16, 10).cast("int") for k in (2, 4, 6)]))
    names = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in NAMED_COLOURS.items() for x in kv])
    rgb = F.coalesce(hexed, F.try_element_at(names, t))
    return F.when(rgb.isNotNull(), F.struct(*[muted(rgb[k]).alias(c) for k, c in enumerate("rgb")]))


def stable_pick(seed: Column, key: Column, n: int) -> Column:
    """A stable number below n for a key: SHA-256 of seed and key."""
    return F.conv(F.substring(F.sha2(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % n
