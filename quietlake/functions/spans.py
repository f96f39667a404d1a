"""Literal occurrences, and choice and replacement of overlapping spans, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_SPANS = "array<struct<start int, stop int, new string, drop boolean>>"


def occurrences(text: Column, value: Column) -> Column:
    """Starts, from 1, of all non-overlapping literal occurrences, left to right."""
    n = F.when(
        F.length(value) > 0,
        ((F.length(text) - F.length(F.replace(text, value, F.lit("")))) / F.length(value)).cast("int"),
    ).otherwise(0)
    begin = F.struct(F.array().cast("array<int>").alias("found"), F.lit(1).alias("at"))

    def step(acc: Column, _: Column) -> Column:
        here = F.call_function("locate", value, text, acc["at"])
        return F.struct(F.concat(acc["found"], F.array(here)).alias("found"), (here + F.length(value)).alias("at"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), begin, step, lambda a: a["found"])).otherwise(F.array().cast("array<int>"))


def all_spans(text: Column, items: Column) -> Column:
    """Spans of every occurrence of ``items`` (old, new, drop), longest first, then leftmost."""
    spans = F.flatten(
        F.transform(
            items,
            lambda i: F.transform(
                occurrences(text, i["old"]),
                lambda s: F.struct(
                    (-F.length(i["old"])).alias("order"),
                    s.alias("start"),
                    (s + F.length(i["old"])).alias("stop"),
                    i["new"].alias("new"),
                    i["drop"].alias("drop"),
                ),
            ),
        )
    )
    return F.transform(
        F.array_sort(spans),
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["new"].alias("new"), s["drop"].alias("drop")),
    )


def disjoint(spans: Column) -> Column:
    """Greedy choice: a span stays if it meets none that stayed before."""
    return F.aggregate(
        spans,
        F.array().cast(_SPANS),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: (k["start"] < s["stop"]) & (s["start"] < k["stop"])),
            kept,
        ).otherwise(F.concat(kept, F.array(s))),
    )


def merge_deletions(spans: Column) -> Column:
    """As ``disjoint``, but a deletion is never lost: whatever it meets becomes one deletion of their hull."""

    def step(kept: Column, s: Column) -> Column:
        meets = lambda k: (k["start"] < s["stop"]) & (s["start"] < k["stop"])
        hit = F.filter(kept, meets)
        hull = F.struct(
            F.least(s["start"], F.array_min(F.transform(hit, lambda k: k["start"]))).alias("start"),
            F.greatest(s["stop"], F.array_max(F.transform(hit, lambda k: k["stop"]))).alias("stop"),
            F.lit("").alias("new"),
            F.lit(True).alias("drop"),
        )
        deletes = s["drop"] | F.exists(hit, lambda k: k["drop"])
        return F.when(F.size(hit) == 0, F.concat(kept, F.array(s))).when(
            deletes,
            F.concat(F.filter(kept, lambda k: ~meets(k)), F.array(hull)),
        ).otherwise(kept)

    once = lambda x: F.aggregate(x, F.array().cast(_SPANS), step)
    return let(once(spans), once)


def rebuild(text: Column, spans: Column) -> Column:
    """The text with each of the disjoint spans replaced."""
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    ordered = F.array_sort(spans)
    return F.aggregate(
        ordered,
        begin,
        lambda a, s: F.struct(
            F.concat(a["out"], F.substring(text, a["at"], s["start"] - a["at"]), s["new"]).alias("out"),
            s["stop"].alias("at"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"], F.length(text))),
    )


def sentence_start(text: Column, at: Column) -> Column:
    """Start of the sentence around a place, from 1: just after the last terminator before it."""
    before = F.substring(text, F.lit(1), at - 1)
    return at - F.least(*[F.length(F.substring_index(before, end, -1)) for end in ".!?。！？；;\n"])


def sentence_stop(text: Column, at: Column) -> Column:
    """First place after the sentence, its terminator and the blanks that follow."""
    return at + F.length(F.regexp_extract(F.substring(text, at, F.length(text)), r"(?U)^[^.!?。！？；;\n]*[.!?。！？；;\n]?\s*", 0))


def mask(text: Column, items: Column) -> Column:
    """All occurrences of the items' ``old`` replaced by ``new``, longest first."""
    return rebuild(text, disjoint(all_spans(text, items)))


def unmask(text: Column, items: Column) -> Column:
    """Every ``new`` replaced by ``old``, longest mask first."""
    ordered = F.array_sort(
        F.transform(items, lambda i: F.struct((-F.length(i["new"])).alias("n"), i["new"].alias("new"), i["old"].alias("old")))
    )
    return F.aggregate(ordered, text, lambda t, i: F.replace(t, i["new"], i["old"]))
