"""Column functions over text that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_trim(c: Column) -> Column:
    """Strip white space at both ends, line breaks included."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def right_trim_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)[ \t]+$", "")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def rough_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded up: the default token counter."""
    return F.ceil(F.length(c) / 4).cast("long")


def percent_saved(before: Column, after: Column) -> Column:
    """Share saved in whole percent, halves up; 0 where there was nothing."""
    return F.when(before > 0, F.floor(100 * (before - after) / before + 0.5)).otherwise(F.lit(0)).cast("long")


def fold(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) rules in order."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def skip_greedy(items: Column, size, limit: Column, most: Column | None = None) -> Column:
    """Of an array, in order, what still fits: an item that would overflow
    ``limit`` is skipped and the next one is tried, up to ``most`` items.

    ``size`` maps an item to its size.  A running sum would be wrong here, as a
    later, smaller item can still fit.
    """
    empty = F.filter(items, lambda x: F.lit(False))
    zero = F.struct(F.lit(0).cast("long").alias("used"), empty.alias("kept"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["used"] + size(x)) <= limit
        if most is not None:
            fits = fits & (F.size(a["kept"]) < most)
        return F.struct(
            F.when(fits, a["used"] + size(x)).otherwise(a["used"]).cast("long").alias("used"),
            F.when(fits, F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"),
        )

    return F.aggregate(items, zero, step, lambda a: a["kept"])


def hide_nul(c: Column) -> Column:
    """U+0000 and U+0001 written as two other control characters each, so that U+0000 can mark places."""
    return F.replace(F.replace(c, F.lit("\x01"), F.lit("\x01\x03")), F.lit("\x00"), F.lit("\x01\x02"))


def show_nul(c: Column) -> Column:
    """Undoes ``hide_nul``."""
    return F.replace(F.replace(c, F.lit("\x01\x02"), F.lit("\x00")), F.lit("\x01\x03"), F.lit("\x01"))
