"""Code trimming: comments, console calls, duplicate imports and lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.functions.text import collapse_blank_lines, hide_nul, js_trim, percent_saved, right_trim_lines, rough_tokens, show_nul
from contextlake.operators.prose import KEEP

BLOCK_COMMENT = r"(?m)^[ \t]*/\*[\s\S]*?\*/[ \t]*$"
CONSOLE = r"^\s*console\.(log|error|warn|info|debug)\("
# code before the first // that is outside quotes and not part of ///; quotes that do not close run to the line's end
INLINE_CODE = r"""^((?:"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|$)|///+|/(?!/)|[^"'`/])*)//(?!/).*$"""


@dataclass(frozen=True)
class Preset:
    comments: bool = False
    console: bool = False
    imports: bool = False
    lines: bool = False
    trailing: bool = True
    blanks: bool = True


PRESETS = {
    "light": Preset(),
    "default": Preset(comments=True, console=True, imports=True),
    "aggressive": Preset(comments=True, console=True, imports=True, lines=True),
}


def _lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def _first_of_each(lines: Column, eligible) -> Column:
    """Lines that are not eligible, and the first of each eligible one (by
    trimmed text).  An array operation: a body's lines stay in one row.  They are
    sorted, so that equal ones stand together, and put back in their order."""
    marked = F.sort_array(F.transform(lines, lambda x, i: F.struct(F.when(eligible(x), js_trim(x)).alias("key"), i.alias("i"), x.alias("x"))))

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda e, j: e["key"].isNull() | ~e["key"].eqNullSafe(F.get(s, j - 1)["key"]))

    kept = F.get(F.transform(F.array(marked), firsts), F.lit(0))  # the lambda binds the array, which is sorted once
    return F.transform(F.sort_array(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def strip_block_comments(c: Column) -> Column:
    return F.regexp_replace(c, BLOCK_COMMENT, "")


def strip_inline_comments(c: Column) -> Column:
    def one(x: Column) -> Column:
        cut = F.rtrim(F.regexp_replace(x, INLINE_CODE, "$1"))
        return F.when(js_trim(x).startswith("//"), F.lit("")).when(x.rlike(INLINE_CODE), F.regexp_replace(cut, r"\s+\z", "")).otherwise(x)

    return F.array_join(F.transform(_lines(c), one), "\n")


def drop_console_calls(c: Column) -> Column:
    return F.array_join(F.filter(_lines(c), lambda x: ~x.rlike(CONSOLE)), "\n")


def dedup_imports(c: Column) -> Column:
    return F.array_join(_first_of_each(_lines(c), lambda x: js_trim(x).startswith("import ")), "\n")


def dedup_lines(c: Column) -> Column:
    return F.array_join(_first_of_each(_lines(c), lambda x: F.length(js_trim(x)) >= 3), "\n")


def trim(df: DataFrame, text_col: str = "text", preset: str | Preset = "default", tokens=rough_tokens) -> DataFrame:
    """``df`` with ``output``, ``rules_applied`` and token counts.

    Keep regions get numbered marks, since the line rules can drop one.  A null
    text stays null; U+0000 is an ordinary character.
    """
    p = PRESETS[preset] if isinstance(preset, str) else preset
    d = df.withColumn("_s", hide_nul(F.col(text_col)))
    d = d.withColumn("_k", F.regexp_extract_all(F.col("_s"), F.lit(KEEP), F.lit(1)))
    pieces = F.split(F.regexp_replace(F.col("_s"), KEEP, "\x00"), "\x00", -1)
    numbered = F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("\x00K"), (i - 1).cast("string"), F.lit("\x00"), x)))
    d = d.withColumn("_t", F.array_join(numbered, ""))
    steps = []
    if p.comments:
        steps += [("Removed block comments", strip_block_comments), ("Removed inline comments", strip_inline_comments)]
    if p.console:
        steps.append(("Removed console statements", drop_console_calls))
    if p.imports:
        steps.append(("Removed duplicate imports", dedup_imports))
    if p.lines:
        steps.append(("Removed duplicate lines", dedup_lines))
    labels = [F.when(F.size("_k") > 0, F.lit("Preserved keep regions"))]
    for i, (label, step) in enumerate(steps):
        d = d.withColumn(f"_b{i}", F.col("_t")).withColumn("_t", step(F.col("_t")))
        d = d.withColumn(f"_a{i}", F.col("_t"))
        labels.append(F.when(F.col(f"_b{i}") != F.col(f"_a{i}"), F.lit(label)))
    if p.trailing:
        d = d.withColumn("_t", right_trim_lines(F.col("_t")))
        labels.append(F.lit("Trimmed trailing whitespace"))
    if p.blanks:
        d = d.withColumn("_b", F.col("_t")).withColumn("_t", collapse_blank_lines(F.col("_t")))
        labels.append(F.when(F.col("_b") != F.col("_t"), F.lit("Collapsed blank lines")))
    parts = F.split(F.col("_t"), "\x00", -1)  # every second part is the number of a keep region
    back = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.element_at("_k", (F.substring(x, 2, 9).cast("int") + 1))).otherwise(x))
    d = d.withColumn("output", js_trim(show_nul(F.array_join(back, "")))).withColumn("rules_applied", F.array_compact(F.array(*labels)))
    before, after = tokens(F.col(text_col)), tokens(F.col("output"))
    d = d.withColumn("original_tokens", before).withColumn("output_tokens", after).withColumn("percent_saved", percent_saved(before, after))
    return d.drop("_s", "_k", "_t", "_b", *[f"_{x}{i}" for x in "ab" for i in range(len(steps))])
