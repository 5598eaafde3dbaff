"""Places of regular-expression matches as DataFrame expressions.

`regexp_extract_all` gives the texts of matches but not their places. The pattern ``(.*?)(pattern)`` splits
a text into gap and match, gap and match: its matches are contiguous, so that running sums of their
lengths are places. Lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,stop:bigint,kind:string,value:string>>"
BLOCK = 256  # matches per block of the running sum; keeps the copying of a text with many matches linear


def no_spans() -> Column:
    return F.array().cast(SPAN)


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _walk(parts: Column, begin: Column, kind: str) -> Column:
    """Spans of one block of (part, value), the first part starting at `begin`."""
    start = F.struct(begin.cast("long").alias("at"), no_spans().alias("found"))

    def step(acc: Column, x: Column) -> Column:
        stop = acc["at"] + F.length(x["part"])
        span = F.struct((stop - F.length(x["value"])).cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(stop.cast("long").alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    return F.aggregate(parts, start, step)


def spans_of(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start,stop,kind,value>> of a pattern's leftmost non-overlapping matches; no text: none.

    In the pattern ``\\G`` is the end of the match before. A text without any match takes one plain search.
    """
    # \G: a gap starts where the match before ended; without it the rest of a text without a further
    # match would be searched again from each of its characters
    both = F.lit(rf"(?s)\G(.*?)({pattern})")
    parts = F.arrays_zip(
        F.regexp_extract_all(text, both, F.lit(0)).alias("part"),
        F.regexp_extract_all(text, both, F.lit(2)).alias("value"),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(F.lit(0).cast("long").alias("at"), no_spans().alias("found"))

    def step(acc: Column, block: Column) -> Column:
        done = _walk(block, acc["at"], kind)
        return F.struct(done["at"].alias("at"), F.concat(acc["found"], done["found"]).alias("found"))

    walked = F.aggregate(blocks, start, step, lambda acc: acc["found"])
    few = _walk(parts, F.lit(0), kind)["found"]
    return F.when(~F.coalesce(text, F.lit("")).rlike(pattern), no_spans()).when(F.size(parts) <= BLOCK, few).otherwise(walked)


def merged_spans(spans: Column) -> Column:
    """Spans sorted and united where they overlap or touch."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["stop"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, F.array().cast("array<struct<start:bigint,stop:bigint>>"), step)


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """`text` with each of the merged spans replaced by `mark`."""
    count = F.size(spans)
    pieces = F.transform(
        F.sequence(F.lit(0), count),
        lambda k: F.substring(
            text,
            (F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(spans, k)["stop"]) + 1).cast("int"),
            (F.when(k == count, F.length(text)).otherwise(F.try_element_at(spans, k + 1)["start"]) - F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(spans, k)["stop"])).cast("int"),
        ),
    )
    return F.array_join(pieces, mark)


def blanked(text: Column, spans: Column) -> Column:
    """`text` with each of the merged spans replaced by as many spaces; all places stay."""
    count, size = F.size(spans), F.length(text)

    def piece(k: Column) -> Column:
        after = F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(spans, k)["stop"])
        start = F.when(k == count, size).otherwise(F.try_element_at(spans, k + 1)["start"])
        stop = F.when(k == count, size).otherwise(F.try_element_at(spans, k + 1)["stop"])
        return F.concat(F.substring(text, (after + 1).cast("int"), (start - after).cast("int")), F.repeat(F.lit(" "), (stop - start).cast("int")))

    return F.array_join(F.transform(F.sequence(F.lit(0), count), piece), "")
