"""Column helpers of the operators that use DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def indices(n: Column) -> Column:
    """0 .. n-1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a Java pattern that never matches nothing: array of (start, stop, hit) in code points.

    The pieces between the matches give the places: a match starts after all pieces and matches before it.
    """
    empty = F.array().cast("array<struct<start:int,stop:int,hit:string>>")

    def place(hits: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("gap"), h.alias("hit")))
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(
            steps, start,
            lambda acc, s: F.struct((acc["at"] + s["gap"] + F.length(s["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + F.length(s["hit"])).alias("stop"), s["hit"].alias("hit")))).alias("out")),
            lambda acc: acc["out"],
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, place(hits)).otherwise(empty))
