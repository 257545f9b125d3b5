"""Log compaction over lines: (doc_id, line_no, line, protected).

All steps partition by ``doc_id``, so a chain of them shares one shuffle.  A
step that drops or adds lines renumbers what it returns.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.functions.jsonblocks import minify_blocks
from contextlake.functions.text import js_trim, percent_saved, right_trim_lines, rough_tokens

# Escape sequences, time stamps, stack frames, and heads of error and warning lines.
ANSI = r"\x1b\[[\d;]*[a-zA-Z]"
TIMESTAMPS = [
    r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?\b",
    r"\[\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?\]",
    r"\[\d{2}:\d{2}:\d{2}(?:[.,]\d{1,3})?\]",
    r"\b\d{2}:\d{2}:\d{2}\.\d{1,3}\b",
    r"\[\d{10}(?:\.\d+)?\]",
]
FRAMES = [
    r"^\s*at\s+[\w$.<>]+\s*\(",
    r"^\s*at\s+[\w$.<>]+\.[\w$<>]+\(",
    r'^\s*File\s+"[^"]+",\s*line\s+\d+',
    r"^\s*[\w./\\-]+\.go:\d+\s+[+\-]0x[0-9a-f]+",
    r"^\s*[\w./\\-]+:\d+:\d+\s",
    r"^Caused by:\s+",
    r"^\s*\.\.\.\s+\d+\s+more\s*$",
]
ERROR_HEAD = r"(?i)^(error|err|fatal|critical|exception|traceback)[\s:]"
WARN_HEAD = r"(?i)^(warn(?:ing)?)[\s:]"


def in_order():
    return Window.partitionBy("doc_id").orderBy("line_no")



@dataclass(frozen=True)
class Preset:
    timestamps: bool = True
    patterns: bool = True
    warnings: bool = True
    minify: bool = True
    longest: int = 500
    ends: int = 0


PRESETS = {
    "mild": Preset(False, False, False, False, 0),
    "balanced": Preset(),
    "aggressive": Preset(longest=200, ends=3),
}


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, "")


def truncate_long(c: Column, limit: int) -> Column:
    over = F.length(c) - limit
    return F.when(over > 0, F.concat(F.substring(c, 1, limit), F.lit(" …[+"), over.cast("string"), F.lit(" chars]"))).otherwise(c)


def mask_timestamps(c: Column) -> Column:
    for pattern in TIMESTAMPS:
        c = F.regexp_replace(c, pattern, "[T]")
    return c


def skeleton(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+", "#")


def minify_json(c: Column) -> Column:
    """JSON blocks to one line each.  Sequential by nature: where a block ends
    depends on what parsed before it."""

    @F.pandas_udf("string")
    def minified(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else minify_blocks(t))

    return minified(c)


def explode_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.select("doc_id", F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def renumber(df: DataFrame, *order: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).cast("long")
    return df.withColumn("line_no", nth).select("doc_id", "line_no", "line", "protected")


def protect_traces(lines: DataFrame) -> DataFrame:
    """Add ``protected``: a frame, the line above one, and what follows an error
    head up to a blank line.  The state is the last event seen."""
    frame = F.lit(False)
    for pattern in FRAMES:
        frame = frame | F.col("line").rlike(pattern)
    blank = js_trim(F.col("line")) == ""
    head = js_trim(F.col("line")).rlike(ERROR_HEAD)
    d = lines.withColumn("_f", frame).withColumn("_b", blank).withColumn("_e", F.when(head | F.col("_f"), True).when(F.col("_b"), False))
    open_ = F.coalesce(F.last("_e", ignorenulls=True).over(in_order()), F.lit(False))
    above = F.coalesce(F.lead("_f").over(in_order()), F.lit(False))
    return d.withColumn("protected", F.col("_f") | above | (open_ & ~F.col("_b"))).drop("_f", "_b", "_e")


def _runs(lines: DataFrame, key: Column, ok: Column) -> DataFrame:
    """``_r``: place in the run of equal keys, ``_c``: length of the run."""
    d = lines.withColumn("_key", key).withColumn("_ok", ok)
    same = F.col("_ok") & F.coalesce(F.lag("_ok").over(in_order()), F.lit(False)) & (F.col("_key") == F.lag("_key").over(in_order()))
    d = d.withColumn("_new", F.when(same, 0).otherwise(1))
    d = d.withColumn("_g", F.sum("_new").over(in_order()))
    run = Window.partitionBy("doc_id", "_g")
    return d.withColumn("_r", F.row_number().over(run.orderBy("line_no"))).withColumn("_c", F.count(F.lit(1)).over(run))


def collapse_duplicates(lines: DataFrame) -> DataFrame:
    d = _runs(lines, F.col("line"), ~F.col("protected")).filter("_c < 3 or _r = 1")
    counted = F.when((F.col("_c") >= 3), F.concat("line", F.lit("  (×"), F.col("_c").cast("string"), F.lit(")"))).otherwise(F.col("line"))
    return renumber(d.withColumn("line", counted), "line_no")


def collapse_patterns(lines: DataFrame) -> DataFrame:
    ok = ~F.col("protected") & F.col("line").rlike(r"\d") & (js_trim(F.col("line")) != "")
    d = _runs(lines, skeleton(F.col("line")), ok).filter("_c < 4 or _r in (1, 2) or _r = _c")
    marker = F.concat(F.lit("  …["), (F.col("_c") - 2).cast("string"), F.lit(" similar lines collapsed]"))
    return renumber(d.withColumn("line", F.when((F.col("_c") >= 4) & (F.col("_r") == 2), marker).otherwise(F.col("line"))), "line_no")


def summarise_warnings(lines: DataFrame) -> DataFrame:
    warn = ~F.col("protected") & js_trim(F.col("line")).rlike(WARN_HEAD)
    d = lines.withColumn("_w", warn).withColumn("_s", skeleton(js_trim(F.col("line"))))
    group = Window.partitionBy("doc_id", "_w", "_s")
    d = d.withColumn("_c", F.count(F.lit(1)).over(group)).withColumn("_r", F.row_number().over(group.orderBy("line_no"))).withColumn("_drop", F.expr("_w and _c > 3 and _r > 2"))
    kept = d.filter("not _drop").select("doc_id", "line_no", F.lit(0).cast("long").alias("seq"), "line", "protected")
    gone = d.filter("_drop").groupBy("doc_id", "_s").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    far = F.lit(2**62).cast("long")
    bullets = gone.select("doc_id", far.alias("line_no"), (F.col("first") + 2).alias("seq"), F.concat(F.lit('  • "'), "_s", F.lit('" — +'), F.col("n").cast("string"), F.lit(" more similar")).alias("line"), F.lit(False).alias("protected"))
    heads = gone.select("doc_id").distinct().select("doc_id", far.alias("line_no"), F.posexplode(F.array(F.lit(""), F.lit("[Warnings summary]"))).alias("seq", "line"), F.lit(False).alias("protected"))
    heads = heads.withColumn("seq", F.col("seq").cast("long") - 1)
    return renumber(kept.unionByName(bullets).unionByName(heads), "line_no", "seq")


def keep_ends(lines: DataFrame, n: int) -> DataFrame:
    """Of each skeleton's lines the first and last ``n``; a marker per gap."""
    key = F.when(~F.col("protected") & (js_trim(F.col("line")) != ""), skeleton(F.col("line")))
    d = lines.withColumn("_s", key)
    group = Window.partitionBy("doc_id", "_s")
    d = d.withColumn("_c", F.count(F.lit(1)).over(group)).withColumn("_r", F.row_number().over(group.orderBy("line_no")))
    d = d.withColumn("_drop", F.expr(f"_s is not null and _c > {2 * n + 1} and _r > {n} and _r <= _c - {n}"))
    d = d.withColumn("_more", F.coalesce(F.lag("_drop").over(in_order()), F.lit(False))).filter("not _drop or not _more")
    return renumber(d.withColumn("line", F.when(F.col("_drop"), F.lit("  …[similar lines omitted]")).otherwise(F.col("line"))), "line_no")


def collapse_blanks(lines: DataFrame) -> DataFrame:
    d = lines.withColumn("_b", js_trim(F.col("line")) == "").withColumn("_p", F.coalesce(F.lag("_b").over(in_order()), F.lit(False)))
    return renumber(d.filter("not (_b and _p)"), "line_no")


def assemble(lines: DataFrame) -> DataFrame:
    """One text per document, lines right-trimmed and the whole trimmed."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return lines.groupBy("doc_id").agg(js_trim(right_trim_lines(F.array_join(ordered, "\n"))).alias("output"), F.count(F.lit(1)).alias("output_lines"))


def compress(df: DataFrame, text_col: str = "text", preset: str | Preset = "balanced", tokens=rough_tokens) -> DataFrame:
    """(doc_id, output, line and token counts) of every text.

    Ids must be unique, as lines belong to their id.  A null text is empty: it has
    no output and one line; without texts the result is empty.
    """
    p = PRESETS[preset] if isinstance(preset, str) else preset
    text = strip_ansi(F.col(text_col))
    d = df.select("doc_id", F.col(text_col).alias("_original"), (minify_json(text) if p.minify else text).alias("text"))
    lines = explode_lines(d)
    if p.longest:
        lines = lines.withColumn("line", truncate_long(F.col("line"), p.longest))
    lines = protect_traces(lines)
    if p.timestamps:
        lines = lines.withColumn("line", mask_timestamps(F.col("line")))
    lines = collapse_duplicates(lines)
    if p.patterns:
        lines = collapse_patterns(lines)
    if p.warnings:
        lines = summarise_warnings(lines)
    if p.ends:
        lines = keep_ends(lines, p.ends)
    out = d.select("doc_id", "_original").join(assemble(collapse_blanks(lines)), "doc_id", "left")
    out = out.withColumns({"_original": F.coalesce("_original", F.lit("")), "output": F.coalesce("output", F.lit("")), "output_lines": F.coalesce("output_lines", F.lit(1))})
    before, after = tokens(F.col("_original")), tokens(F.col("output"))
    return out.select(
        "doc_id", "output", F.size(F.split("_original", "\n", -1)).cast("long").alias("input_lines"), "output_lines", before.alias("original_tokens"), after.alias("output_tokens"), percent_saved(before, after).alias("percent_saved")
    )
