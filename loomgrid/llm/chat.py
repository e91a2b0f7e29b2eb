"""Chat formatting in budgeted windows, in DataFrame functions only.

A turn is written `### role: text</turn>` and a newline. The backslash, the two marks and, in roles, the colon are escaped, so
no text can look like a mark and the output reads back exactly. Prefix sums of the turns' tokens cut a conversation into
turn-aligned windows of a token budget. Every window begins with the leading system turn, then repeats as many of the
preceding turns as fit the history budget, then has its new turns. The loss mask covers new assistant texts only: repeated
ones are masked out, so each is a target once.

A conversation of any length is worked on in segments of `segment` turns: turns get their number from a range partitioning
(each part numbers its own, and only the parts' sizes are summed), a window ends with its segment, and the turns that may be
history are sent to the next segment too. So no task holds more than its segments, even if one conversation has most turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import stored
from loomgrid.llm.native import indices, let

OPEN, CLOSE = "### ", "</turn>\n"
_ESCAPES = [("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t")]


def escape(text: Column) -> Column:
    for raw, safe in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """Undo escape(): parts between doubled backslashes hold single escapes only."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(F.replace(p, F.lit("\\h"), F.lit("###")), F.lit("\\t"), F.lit("</turn>")), F.lit("\\c"), F.lit(":")))
    return F.array_join(plain, "\\")


#: Pieces as byte-level tokenizers first part a text: letters with the blank before them, digits, other signs, blanks.
_PIECES = r" ?\p{L}{1,6}| ?\p{N}{1,3}| ?[^\s\p{L}\p{N}]{1,3}|\s+"


def count_tokens(text: Column) -> Column:
    """Tokens of a text by a pre-tokenizer's pattern, in which words count a token for every six letters."""
    return F.regexp_count(text, F.lit(_PIECES)).cast("long")


def numbered(turns: DataFrame) -> DataFrame:
    """Add `at`, the number of a turn in its conversation: by turn, role and text."""
    parted = turns.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    parted = stored(parted.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "turns")
    here = Window.partitionBy("conv_id", "part")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of a conversation
    sizes = parted.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = parted.withColumn("own", F.row_number().over(here.orderBy("row")) - 1)
    return placed.join(sizes, (placed.conv_id.eqNullSafe(sizes.conv_id)) & (placed.part == sizes.part)).select(placed.conv_id, "role", "text", (F.col("first") + F.col("own")).alias("at"))


def windows(conversations: DataFrame, budget: int = 1024, history: int = 256, segment: int = 128, tokens: Callable[[Column], Column] = count_tokens) -> DataFrame:
    """conv_id, window, formatted, n_context (leading turns that are repeats), loss (spans of formatted, in code points).

    Turns are in the order of turn, then role, then text, so ties and repeated rows have a defined place; a null turn comes
    first, null roles and texts are empty, null conv_ids are one conversation. A turn above the budget is a window of its own
    and is never cut. `tokens` counts the tokens of a text; each turn has four more for its marks. Windows are numbered in
    order, not without gaps. Columns of other names are ignored.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = numbered(turns)
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": "))
    written = known.select("conv_id", "at", F.struct("at", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("target"), (F.col("role") == "system").alias("system"), (tokens(F.col("text")) + 5).alias("tokens")).alias("t"))
    written = stored(written, "written")
    # a turn has five tokens at least, so only so many can be history
    reach = min(segment, history // 5 + 1)
    here = F.floor(F.col("at") / segment)
    also = F.when(F.col("at") % segment >= segment - reach, F.array(here, here + 1)).otherwise(F.array(here))
    grouped = written.select("conv_id", F.explode(also).alias("seg"), "t").groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list("t")).alias("w"))
    grouped = grouped.where(F.element_at("w", -1)["at"] >= F.col("seg") * segment)
    first = written.where((F.col("at") == 0) & F.col("t.system")).select(F.col("conv_id").alias("c"), F.struct("t.head", "t.body", "t.tokens").alias("lead"))
    base = grouped.join(first, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    # the leading system turn stands before every window, and so is no turn of the first segment
    led = F.col("lead").isNotNull()
    base = base.withColumn("w", F.filter("w", lambda x: ~led | (x["at"] > 0)))
    base = base.withColumn("new", F.size(F.filter("w", lambda x: x["at"] < F.col("seg") * segment)))  # where the new turns begin
    # prefix sums: before[i] is what precedes turn i; a segment is short, so growing the array is cheap
    sums = F.aggregate("w", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["tokens"])))
    base = base.withColumn("before", sums).withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce(F.col("lead.tokens"), F.lit(0))))
    # a window's first new turn: the first that would pass the room after the window's own start
    begin = F.struct(F.col("new").alias("at"), F.array("new").alias("starts"))

    def step(acc: Column, i: Column) -> Column:
        over = (i > acc["at"]) & (F.get("before", i + 1) - F.get("before", acc["at"]) > F.col("room"))
        return F.struct(F.when(over, i).otherwise(acc["at"]).alias("at"), F.when(over, F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"]).alias("starts"))

    starts = F.aggregate(indices(F.size("w")), begin, step, lambda acc: acc["starts"])
    cutted = base.withColumn("starts", starts).select("*", F.posexplode("starts").alias("k", "start"))
    stop = F.coalesce(F.get("starts", F.col("k") + 1), F.size("w"))
    # how far back the history reaches: prefix sums are sorted, so those within it are counted among the last `reach` only
    recent = F.slice("before", F.greatest(F.col("start") - reach, F.lit(0)) + 1, F.least(F.col("start"), F.lit(reach)))
    back = F.size(F.filter(recent, lambda b: F.get("before", "start") - b <= history))
    sized = cutted.select("conv_id", (F.col("seg") * segment + F.col("k")).cast("long").alias("window"), "w", "lead", stop.alias("stop"), "start", back.alias("n_back"))
    part = lambda x, target: F.struct(x["head"].alias("head"), x["body"].alias("body"), target.alias("target"))
    parts = F.concat(
        F.when(F.col("lead").isNotNull(), F.array(part(F.col("lead"), F.lit(False)))).otherwise(F.array().cast("array<struct<head:string,body:string,target:boolean>>")),
        F.transform(F.slice("w", F.col("start") - F.col("n_back") + 1, F.col("n_back")), lambda x: part(x, F.lit(False))),
        F.transform(F.slice("w", F.col("start") + 1, F.col("stop") - F.col("start")), lambda x: part(x, x["target"])),
    )
    full = sized.select("conv_id", "window", parts.alias("parts"), (F.col("n_back") + F.when((F.col("window") > 0) & F.col("lead").isNotNull(), 1).otherwise(0)).alias("n_context"))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    walk = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), none.alias("loss")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).alias("at"),
            F.when(x["target"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), (acc["at"] + F.length(x["head"]) + F.length(x["body"])).alias("stop"))))).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    joined = F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return full.select("conv_id", "window", joined.alias("formatted"), "n_context", walk.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted window: array of (role, text)."""

    def turn(x: Column) -> Column:
        cut = F.instr(x, ": ")
        return F.struct(unescape(F.substring(x, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"), unescape(F.substring(x, cut + 2, F.length(x))).alias("text"))

    return F.transform(F.filter(F.split(formatted, CLOSE, -1), lambda x: x != ""), turn)


def digests(formatted: DataFrame) -> DataFrame:
    """Read windows back: per conversation its turns and loss texts, as counts and digests.

    A digest of a conversation's whole text needs that text in one row; windows() has no such row.
    """
    turns = parse(F.col("formatted"))
    fresh = let(turns, lambda t: F.slice(t, F.col("n_context") + 1, F.size(t)))
    texts = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    # context that is not leading: the first window has its system turn as a new one
    read = formatted.select("conv_id", "window", fresh.alias("turns"), F.array_join(texts, "").alias("loss"), F.length("formatted").cast("long").alias("n"))
    row = F.struct("window", "turns", "loss")
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.sum("n").alias("formatted_chars"))
    flat = F.flatten(F.transform("rows", lambda r: r["turns"]))
    loss = F.array_join(F.transform("rows", lambda r: r["loss"]), "")
    out = whole.select("conv_id", flat.alias("turns"), loss.alias("loss"), "formatted_chars")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op9_chat(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    # rows of the table that are numbered -7 would come before the added ones
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), (F.col("id") + F.lit(2**62)).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return digests(windows(table.unionByName(extra)))
