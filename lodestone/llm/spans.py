"""Spans of regular-expression matches, and running totals in arrays, with built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,size:bigint>>"
#: Elements of an array that are gone through in one stretch: appending to a list copies it, so stretches are short.
STRETCH = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs what `join` (a sum, a maximum) makes of 0 and all before it.

    Stretches are gone through by themselves, then their totals, then each stretch takes in
    what was before it: the work for n values is some 2 * STRETCH * n copies, and not n * n.
    """

    def scan(x: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, start, lambda acc, v: F.struct(join(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def whole(x: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / STRETCH).cast("int")), lambda i: scan(F.slice(x, i * STRETCH + 1, F.lit(STRETCH))))
        return let(cut, lambda parts: F.flatten(F.zip_with(parts, scan(F.transform(parts, lambda p: p["at"]))["out"], lambda p, before: F.transform(p["out"], lambda v: join(before, v)))))

    return let(values, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(F.array().cast("array<bigint>")))


def regex_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, size): code points, end exclusive, and
    the length of one group.  What split() leaves between the matches gives their places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.char_length) if group else F.transform(matches, F.char_length)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    steps = F.zip_with(F.arrays_zip(matches.alias("m"), sizes.alias("s")), gaps, lambda x, g: F.struct(F.char_length(x["m"]).cast("long").alias("m"), x["s"].cast("long").alias("s"), g.cast("long").alias("g")))

    def spans(steps: Column) -> Column:
        before = running(F.transform(steps, lambda x: x["m"] + x["g"]), lambda a, b: a + b)
        return F.zip_with(steps, before, lambda x, at: F.struct((at + x["g"]).alias("start"), (at + x["g"] + x["m"]).alias("end"), x["s"].alias("size")))

    found = let(F.filter(steps, lambda x: x["m"].isNotNull()), spans)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(SPAN))
