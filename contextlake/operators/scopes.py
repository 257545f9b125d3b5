"""Whole prompts: prose, context blocks of scope tags, and honest accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.functions.text import js_trim, percent_saved, rough_tokens
from contextlake.operators import code, diffs, prose, session, symbols

MODES = r"@(optimize|compress)\b"
AROUND = 25


def block(label: Column, body: Column) -> Column:
    return F.concat(F.lit("[Context: "), label, F.lit("]\n```\n"), body, F.lit("\n```"))


def optimise(df: DataFrame, text_col: str = "text", prose_preset: str = "default", code_preset: str = "default") -> DataFrame:
    """Adds ``clean`` (without tags) and ``prose``: compressed and trimmed, or
    only what a mode tag asks for."""
    d = symbols.mode_flags(df, text_col).withColumnRenamed("compress", "do_compress").withColumnRenamed("trim", "do_trim")
    d = d.withColumn("clean", js_trim(F.regexp_replace(symbols.strip_scopes(F.col(text_col)), MODES, "")))
    d = prose.compress(d, "clean", prose_preset).withColumn("_p", F.when(F.col("do_compress"), F.col("output")).otherwise(F.col("clean")))
    d = d.drop("output", "rules_applied", "original_tokens", "output_tokens", "percent_saved")
    d = code.trim(d, "_p", code_preset).withColumn("prose", F.when(F.col("do_trim"), F.col("output")).otherwise(F.col("_p")))
    return d.drop("output", "rules_applied", "original_tokens", "output_tokens", "percent_saved", "do_compress", "do_trim", "_p")


def file_blocks(tags: DataFrame, files: DataFrame, table: DataFrame) -> DataFrame:
    """Blocks of the tags that need a prompt's file: (prompt_id, pos, tag, key, block).

    ``tags`` carry ``rel_path``; ``files`` are (rel_path, body), ``table`` holds
    symbols.  What cannot be found gives a message and no key.
    """
    tag = F.concat_ws(":", F.lit("scope"), "kind", "name")
    t = tags.withColumn("tag", tag)
    whole = t.filter("kind = 'file'").join(files, "rel_path")
    whole = whole.select("prompt_id", "pos", "tag", session.key("file", F.col("rel_path")).alias("key"), block(F.concat(F.lit("file "), "rel_path"), F.col("body")).alias("block"))
    named = t.filter("kind in ('symbol', 'class')").withColumn("qid", F.concat_ws("/", F.col("prompt_id").cast("string"), F.col("pos").cast("string")))
    found = symbols.match_symbols(named.filter("name is not null").select(F.col("qid").alias("query_id"), "rel_path", F.col("name").alias("query")), table)
    got = named.join(found.select(F.col("query_id").alias("qid"), F.col("name").alias("hit")), "qid", "left")
    missing = F.when(F.col("name").isNull(), F.concat(F.lit("[Missing "), "kind", F.lit(" name: use @scope:"), "kind", F.lit(":<name>]"))).otherwise(F.concat(F.initcap("kind"), F.lit(' "'), "name", F.lit('" not found in file]')))
    missing = F.when(F.col("name").isNull(), missing).otherwise(F.concat(F.lit("["), missing))
    key = F.when(F.col("hit").isNotNull(), F.concat(F.col("kind"), F.lit(":"), F.concat_ws("#", "rel_path", "hit")))
    body = F.when(F.col("hit").isNull(), missing).otherwise(block(F.concat("kind", F.lit(" "), "hit", F.lit(" in "), "rel_path"), F.col("hit")))
    by_name = got.select("prompt_id", "pos", "tag", key.alias("key"), body.alias("block"))
    kinds = table.filter(F.col("kind_code").isin(*symbols.TYPE_KINDS)).groupBy("rel_path").agg(F.array_sort(F.collect_list("name")).alias("names"))
    types = t.filter("kind = 'types'").join(kinds, "rel_path", "left")
    listed = block(F.concat(F.size("names").cast("string"), F.lit(" type(s) in "), "rel_path"), F.array_join("names", "\n\n"))
    types = types.select("prompt_id", "pos", "tag", F.when(F.col("names").isNotNull(), session.key("types", F.col("rel_path"))).alias("key"), F.when(F.col("names").isNull(), F.lit("[No types/interfaces/enums found in file]")).otherwise(listed).alias("block"))
    return whole.unionByName(by_name).unionByName(types)


def _text(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, (start + 1).cast("int"), (end - start + 1).cast("int")), "\n")


def function_blocks(tags: DataFrame, files: DataFrame, table: DataFrame) -> DataFrame:
    """Blocks of ``fn`` tags, which carry ``rel_path`` and a ``cursor`` line: the
    smallest symbol there, else the function around, else the lines around."""
    t = tags.filter("kind = 'fn'").join(files, "rel_path").withColumn("lines", F.split("body", "\n", -1)).withColumn("last", (F.size("lines") - 1).cast("long"))
    t = t.withColumn("doc_id", F.concat_ws("/", F.col("prompt_id").cast("string"), F.col("pos").cast("string"))).withColumn("tag", F.concat_ws(":", F.lit("scope"), "kind", "name"))
    t = t.select("doc_id", "prompt_id", "pos", "tag", "rel_path", "cursor", "lines", "last")
    held = t.select("doc_id", "rel_path", "cursor").join(table.select("rel_path", "name", "symbol_no", "kind_code", "start_line", "end_line"), "rel_path").filter("cursor between start_line and end_line")
    held = held.groupBy("doc_id").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "symbol_no", F.col("name").alias("symbol"), "kind_code", "start_line", "end_line")).alias("s"))
    t = t.join(held, "doc_id", "left")
    rest = t.filter("s is null")
    around = symbols.function_around(rest.select("doc_id", F.posexplode("lines").alias("line_no", "line")), rest.select("doc_id", "cursor"))
    t = t.join(around, "doc_id", "left")
    start = F.coalesce("s.start_line", "start_line", F.greatest(F.lit(0), F.col("cursor") - AROUND))
    end = F.least("last", F.coalesce("s.end_line", "end_line", F.col("cursor") + AROUND))
    t = t.withColumn("start", start.cast("long")).withColumn("end", end.cast("long"))
    span = F.format_string("lines %d–%d", F.col("start") + 1, F.col("end") + 1)
    label = F.when(F.col("s").isNull(), span).otherwise(F.concat(symbols.kind_name(F.col("s.kind_code")), F.lit(' "'), F.col("s.symbol"), F.lit('" ('), span, F.lit(")")))
    key = F.when(F.col("s").isNull(), F.format_string("fn:%s:%d-%d", "rel_path", "start", "end")).otherwise(session.key("symbol", F.col("rel_path"), F.col("s.symbol")))
    return t.select("prompt_id", "pos", "tag", key.alias("key"), block(label, _text(F.col("lines"), F.col("start"), F.col("end"))).alias("block"))


def import_blocks(tags: DataFrame, files: DataFrame) -> DataFrame:
    """Blocks of ``imports`` tags, which carry ``rel_path``."""
    t = tags.filter("kind = 'imports'").withColumn("tag", F.concat_ws(":", F.lit("scope"), "kind", "name"))
    used = files.join(t.select("rel_path").distinct(), "rel_path", "left_semi").withColumn("lines", F.split("body", "\n", -1))
    found = symbols.import_ranges(used.select(F.col("rel_path").alias("doc_id"), F.posexplode("lines").alias("line_no", "line"))).withColumnRenamed("doc_id", "rel_path")
    found = found.join(used.select("rel_path", "lines"), "rel_path")
    label = F.format_string("imports of %s (lines %d–%d)", "rel_path", F.col("start_line") + 1, F.col("end_line") + 1)
    found = found.select("rel_path", block(label, _text(F.col("lines"), F.col("start_line"), F.col("end_line"))).alias("b"))
    key = F.when(F.col("b").isNotNull(), session.key("imports", F.col("rel_path")))
    return t.join(found, "rel_path", "left").select("prompt_id", "pos", "tag", key.alias("key"), F.coalesce("b", F.lit("[No imports detected at top of file]")).alias("block"))


def diff_blocks(tags: DataFrame, changes: DataFrame, budget: int = 8000) -> DataFrame:
    """Blocks of ``diff``, ``staged`` and ``last-commit`` tags, which carry
    ``diff_id``; ``changes`` are (diff_id, kind, diff)."""
    t = tags.filter("kind in ('diff', 'staged', 'last-commit')").withColumn("tag", F.concat_ws(":", F.lit("scope"), "kind", "name"))
    used = diffs.truncate(changes.join(t.select("diff_id", "kind").distinct(), ["diff_id", "kind"], "left_semi"), budget).withColumn("l", F.split("diff", "\n", -1))
    count = lambda sign, not_: F.size(F.filter("l", lambda x: x.startswith(sign) & ~x.startswith(not_))).cast("long")
    files = F.size(F.filter("l", lambda x: x.startswith("diff --git"))).cast("long")
    before, after = rough_tokens(F.col("diff")), rough_tokens(F.col("truncated"))
    base = F.when(F.col("kind") == "diff", "working").otherwise(F.col("kind"))
    named = F.when(F.col("kind") == "diff", "uncommitted (working tree)").when(F.col("kind") == "staged", "staged (index)").otherwise("last commit (HEAD~1..HEAD)")
    note = F.when(after < before, F.format_string("  (truncated from %d → %d tokens, budget %d)", before, after, F.lit(budget))).otherwise("")
    shown = F.concat(F.lit("[Context: "), diffs.summary(named, files, count("+", "+++"), count("-", "---")), note, F.lit("]\n```diff\n"), F.col("truncated"), F.lit("\n```"))
    used = used.select("diff_id", "kind", shown.alias("b"))
    which = F.when(F.col("kind") == "diff", "unstaged").when(F.col("kind") == "staged", "staged").otherwise("recent")
    key = F.when(F.col("b").isNotNull(), session.key("diff", base))
    nothing = F.concat(F.lit("[No "), which, F.lit(" changes]"))
    return t.join(used, ["diff_id", "kind"], "left").select("prompt_id", "pos", "tag", key.alias("key"), F.coalesce("b", nothing).alias("block"))


def unresolved_blocks(tags: DataFrame) -> DataFrame:
    """A message for each kind that needs what the tables don't hold."""
    t = tags.filter("kind in ('auto', 'repo-map', 'semantic')")
    message = F.concat(F.lit("[@scope:"), "kind", F.lit(": no workspace index to search]"))
    return t.select("prompt_id", "pos", F.concat_ws(":", F.lit("scope"), "kind", "name").alias("tag"), F.lit(None).cast("string").alias("key"), message.alias("block"))


def assemble(blocks: DataFrame) -> DataFrame:
    """(prompt_id, context, labels): blocks in order; a key that stood before in
    the prompt leaves a note instead of its block."""
    d = symbols.repeated_scopes(blocks)
    again = F.col("deduped") & F.col("key").isNotNull()
    shown = F.when(again, F.concat(F.lit("[Context: "), "key", F.lit(" — already included above (dedup)]"))).otherwise(F.col("block"))
    label = F.when(again, F.concat("tag", F.lit(" (deduped)"))).otherwise(F.col("tag"))
    rows = d.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("b"), label.alias("l")))).alias("r"))
    return rows.select("prompt_id", F.array_join(F.transform("r", lambda x: F.concat(F.lit("\n\n"), x["b"])), "").alias("context"), F.transform("r", lambda x: x["l"]).alias("labels"))


def account(df: DataFrame, tokens=rough_tokens) -> DataFrame:
    """Prose in, out and saved (never below 0), context and total tokens, and the
    alert for prose of 30 tokens or more that lost 70 % or more."""
    before, after = tokens(F.col("clean")), tokens(F.col("prose"))
    context = F.coalesce("context", F.lit(""))
    d = df.withColumn("prose_in", before).withColumn("prose_out", after).withColumn("prose_saved", F.greatest(F.lit(0), before - after).cast("long"))
    d = d.withColumn("percent", percent_saved(F.col("prose_in"), F.col("prose_in") - F.col("prose_saved")))
    d = d.withColumn("context_tokens", tokens(context)).withColumn("total_tokens", tokens(F.concat("prose", context)))
    return d.withColumn("alert", (F.col("percent") >= 70) & (F.col("prose_in") >= 30))
