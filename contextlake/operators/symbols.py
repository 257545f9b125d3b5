"""Import ranges, symbol look-ups, scope tags and line diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.functions.text import js_trim

# Lines that import, lines that may stand between imports, tag kinds, and the names of symbol codes.
IMPORTS = [
    r"^\s*import\s+",
    r"^\s*from\s+[\w.]+\s+import\s",
    r"""^\s*from\s+['"][^'"]+['"]\s+import""",
    r"^\s*const\s+[\w{},*\s]+\s*=\s*require\(",
    r"^\s*let\s+[\w{},*\s]+\s*=\s*require\(",
    r"^\s*var\s+[\w{},*\s]+\s*=\s*require\(",
    r"^\s*using\s+[\w.]+;",
    r"^\s*use\s+[\w\\:]+",
    r'^\s*#include\s*[<"]',
    r"""^\s*require\s+['"][^'"]+['"]""",
    r"^\s*package\s+[\w.]+",
]
FILLER = r"""^(//|#|/\*|\*|\"\"\"|''')"""
SCOPES = r"@scope:(fn|file|imports|types|symbol|class|diff|staged|last-commit|auto|repo-map|semantic)(?::([\w.$<>-]+))?"
KIND_NAMES = "file module namespace package class method property field constructor enum interface function variable constant string number boolean array object key null enummember struct event operator typeparameter".split()
TYPE_KINDS = (10, 25, 9, 21, 22)
FUNCTION_HEADS = [
    r"^\s*(export\s+)?(async\s+)?function\s+(\w+)\s*\(",
    r"^\s*(export\s+)?(const|let|var)\s+(\w+)\s*=\s*(async\s+)?\(",
    r"^\s*(export\s+)?(const|let|var)\s+(\w+)\s*=\s*(async\s+)?\w*\s*=>",
    r"^\s*(async\s+)?(\w+)\s*\([^)]*\)\s*\{",
    r"^\s*def\s+(\w+)\s*\(",
]


def _any(c: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(p)
    return found


def import_ranges(lines: DataFrame) -> DataFrame:
    """(doc_id, start_line, end_line) of the import section at the top, counted
    from 0; no row where code comes first or nothing is imported."""
    t = js_trim(F.col("line"))
    kind = lines.select("doc_id", "line_no", _any(F.col("line"), IMPORTS).alias("imp"), ((t == "") | t.rlike(FILLER)).alias("fill"))
    kind = kind.withColumn("stop", F.expr("not imp and not fill"))
    firsts = kind.groupBy("doc_id").agg(F.min(F.expr("case when imp then line_no end")).alias("start_line"), F.min(F.expr("case when stop then line_no end")).alias("code"))
    firsts = firsts.filter("start_line is not null and (code is null or code > start_line)")
    inside = kind.filter("imp").join(firsts, "doc_id").filter("code is null or line_no < code")
    return inside.groupBy("doc_id").agg(F.min("start_line").cast("long").alias("start_line"), F.max("line_no").cast("long").alias("end_line"))


def match_symbols(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per query (query_id, rel_path, query): the first symbol of the file with
    that name, else ignoring case, else containing it."""
    q = queries.filter("query <> ''")
    j = q.join(symbols, "rel_path")
    tier = F.expr("case when name = query then 1 when lower(name) = lower(query) then 2 when contains(lower(name), lower(query)) then 3 end")
    j = j.withColumn("tier", tier).filter("tier is not null")
    best = j.groupBy("query_id").agg(F.min(F.struct("tier", "symbol_no", "name")).alias("b"))
    return best.select("query_id", F.col("b.name").alias("name"), F.col("b.tier").cast("long").alias("tier"))


def symbol_at(cursors: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per cursor (cursor_id, rel_path, line): the smallest range that holds it."""
    j = cursors.join(symbols, "rel_path").filter("line between start_line and end_line")
    best = j.groupBy("cursor_id").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "symbol_no", "name")).alias("b"))
    return best.select("cursor_id", F.col("b.name").alias("name"), F.col("b.span").cast("long").alias("span"))


def kind_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(k) for k in KIND_NAMES]), code.cast("int")), F.lit("symbol"))


def scope_tags(df: DataFrame, id_col: str = "prompt_id", text_col: str = "text") -> DataFrame:
    """(id, pos, kind, name) of the tags in order; name is null where absent."""
    kinds = F.regexp_extract_all(F.col(text_col), F.lit(SCOPES), F.lit(1))
    names = F.regexp_extract_all(F.col(text_col), F.lit(SCOPES), F.lit(2))
    rows = df.select(id_col, F.posexplode(F.arrays_zip(kinds.alias("kind"), names.alias("name"))).alias("pos", "t"))
    return rows.select(id_col, F.col("pos").cast("long").alias("pos"), F.col("t.kind").alias("kind"), F.nullif(F.col("t.name"), F.lit("")).alias("name"))


def strip_scopes(c: Column) -> Column:
    return js_trim(F.regexp_replace(F.regexp_replace(c, SCOPES, ""), r"[ \t]{2,}", " "))


def mode_flags(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``compress`` and ``trim``: one tag alone restricts the work to it."""
    o, c = F.col(text_col).contains("@optimize"), F.col(text_col).contains("@compress")
    return df.withColumn("compress", c | ~o).withColumn("trim", o | ~c)


def repeated_scopes(tags: DataFrame) -> DataFrame:
    """Adds ``deduped``: the tag's key stood earlier in the prompt."""
    w = Window.partitionBy("prompt_id", "key").orderBy("pos")
    return tags.withColumn("deduped", F.row_number().over(w) > 1)


def line_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, line_no, status): an original line is kept if blank or if its
    trimmed text is among the output's lines.

    Both sides grow with the corpus, whatever size is estimated from the files
    they come from: they are merged and never broadcast."""
    seen = after.select("doc_id", js_trim(F.col("line")).alias("t")).distinct().withColumn("hit", F.lit(True))
    d = before.withColumn("t", js_trim(F.col("line"))).join(seen.hint("merge"), ["doc_id", "t"], "left")
    return d.select("doc_id", "line_no", F.when((F.col("t") == "") | F.col("hit"), "kept").otherwise("removed").alias("status"))


def function_around(lines: DataFrame, cursors: DataFrame) -> DataFrame:
    """(doc_id, start_line, end_line) of the function around a cursor line: the
    last head at or above it, up to the line that closes its braces (for
    ``def``: up to the line before the next one indented no deeper).

    Cursors and heads are as many as documents: they are merged and never broadcast."""
    heads = lines.join(cursors.hint("merge"), "doc_id").filter("line_no <= cursor").filter(_any(F.col("line"), FUNCTION_HEADS))
    start = heads.groupBy("doc_id").agg(F.max(F.struct("line_no", "line")).alias("h")).select("doc_id", F.col("h.line_no").alias("start_line"), F.col("h.line").alias("head"))
    body = lines.join(start.hint("merge"), "doc_id").filter("line_no >= start_line")
    depth = F.sum(F.expr("length(regexp_replace(line, '[^{]', '')) - length(regexp_replace(line, '[^}]', ''))")).over(Window.partitionBy("doc_id").orderBy("line_no"))
    indent = "length(regexp_extract({0}, '^[ \\t]*', 0))"
    ends = F.expr(
        f"""case when head rlike '^\\s*def ' then case when line_no > start_line and trim(line) <> '' and {indent.format('line')} <= {indent.format('head')} then line_no - 1 end
        when depth = 0 and (opened or contains(line, '}}')) then line_no end"""
    )
    body = body.withColumn("depth", depth).withColumn("opened", F.max(F.col("line").contains("{")).over(Window.partitionBy("doc_id").orderBy("line_no")))
    found = body.withColumn("e", ends).groupBy("doc_id").agg(F.min("start_line").alias("start_line"), F.coalesce(F.min("e"), F.max("line_no")).alias("end_line"))
    return found.select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))
