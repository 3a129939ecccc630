"""Places of all matches of a pattern, by built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int>>"
#: Matches whose places are summed up together. Arrays grow within such a block only, as a fold copies what it has grown.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0, holds: tuple[str, ...] = ()) -> Column:
    """Spans (kind, start, end; code points, end exclusive) of the leftmost non-overlapping matches of `pattern`.

    Matches whose `group` is shorter than `least`, or that lack any of the patterns `holds`, are left out, yet none begins
    inside them. The lengths of the pieces between matches give the places. Texts without a match cost one search.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))

    def shape(x: Column) -> Column:
        good = F.length(x["g"]) >= least
        for p in holds:
            good = good & x["m"].rlike(p)
        return F.struct(F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"), good.alias("good"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        own = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["good"], F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    def placed(blocks: Column) -> Column:
        none = F.array().cast("array<int>")
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        firsts = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, b: F.struct((acc["at"] + length(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        fold = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, firsts, fold))

    # The piece after the last match has no match beside it.
    shaped = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), shape)
    blocks = let(shaped, lambda all_: F.transform(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(BLOCK)), lambda k: F.slice(all_, k + 1, BLOCK)))
    return F.when(text.rlike(pattern), let(blocks, placed)).otherwise(F.array().cast(SPAN))


def rendered(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
