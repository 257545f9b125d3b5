"""Repository maps: trees, names and signatures, cut to a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextlake.functions.text import rough_tokens


def size_text(bytes_: Column) -> Column:
    kilo, mega = F.format_string("%.1fk", bytes_ / 1024.0), F.format_string("%.1fM", bytes_ / 1048576.0)
    return F.when(bytes_ < 1024, F.concat(bytes_.cast("string"), F.lit("b"))).when(bytes_ < 1048576, kilo).otherwise(mega)


def _listing(files_symbols: DataFrame, line: Column, id_col: str) -> DataFrame:
    """Blocks of a path and its symbols' lines, in path order, blank lines between."""
    blocks = files_symbols.groupBy(id_col, "rel_path").agg(F.array_sort(F.collect_list(F.struct("symbol_no", line.alias("l")))).alias("s"))
    block = F.concat_ws("\n", "rel_path", F.array_join(F.transform("s", lambda x: x["l"]), "\n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rel_path", block.alias("b")))), lambda x: x["b"]), "\n\n")
    return blocks.groupBy(id_col).agg(whole.alias("map"))


def names(symbols: DataFrame, id_col: str = "map_id") -> DataFrame:
    """(id, map): ``  • name (kind)`` under each path; files without symbols are absent."""
    return _listing(symbols, F.format_string("  • %s (%s)", "name", "kind"), id_col)


def signatures(symbols: DataFrame, id_col: str = "map_id") -> DataFrame:
    """(id, map): trimmed signature lines, or kind and name where there is none."""
    shown = F.trim(F.coalesce(F.nullif(F.col("signature"), F.lit("")), F.concat_ws(" ", "kind", "name")))
    return _listing(symbols, F.concat(F.lit("  "), shown), id_col)


def draw_tree(paths: list[tuple[str, str | None]]) -> str:
    """Directories first, then by name; sizes in brackets.  A path that is a file
    and a folder stands as both; of a repeated file the last size counts."""
    if not paths:
        return "(no files)"
    root: dict = {}
    for path, size in paths:
        *folders, name = path.replace("\\", "/").split("/")
        at = root
        for f in folders:
            at = at.setdefault((f, True), {})
        at[name, False] = size
    out: list[str] = []

    def walk(node: dict, prefix: str) -> None:
        keys = sorted(node, key=lambda k: (not k[1], k[0]))
        for i, (name, folder) in enumerate(keys):
            last, inner = i == len(keys) - 1, node[name, folder]
            branch = prefix + ("└── " if last else "├── ") + name
            if folder:
                out.append(branch + "/")
                walk(inner, prefix + ("    " if last else "│   "))
            else:
                out.append(branch + (f" ({inner})" if inner is not None else ""))

    walk(root, "")
    return "\n".join(out)


def tree(files: DataFrame, id_col: str = "map_id") -> DataFrame:
    """(id, map) of all paths of a map (rel_path, size_bytes)."""

    @F.pandas_udf("string")
    def drawn(lists: pd.Series) -> pd.Series:
        return lists.map(lambda rows: draw_tree([(r["rel_path"], r["size"]) for r in rows]))

    listed = files.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rel_path", size_text(F.col("size_bytes")).alias("size")))).alias("l"))
    return listed.select(id_col, drawn("l").alias("map"))


def cut(c: Column, budget: int, tokens=rough_tokens) -> Column:
    """Blocks that fit, skipping larger ones; the first always stays."""
    blocks = F.split(c, r"\n\n+", -1)
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.filter(blocks, lambda x: F.lit(False)).alias("kept"), F.lit(0).alias("i"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["i"] == 0) | (a["used"] + tokens(x) <= budget)
        return F.struct(
            F.when(fits, a["used"] + tokens(x)).otherwise(a["used"]).alias("used"),
            F.when(fits, F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"),
            (a["i"] + 1).alias("i"),
        )

    kept = F.aggregate(blocks, zero, step, lambda a: a["kept"])
    gone = F.size(blocks) - F.size(kept)
    note = F.concat(F.lit("[+"), gone.cast("string"), F.when(gone > 1, F.lit(" more file blocks")).otherwise(F.lit(" more file block")), F.lit(" omitted to fit budget]"))
    return F.when(tokens(c) <= budget, c).otherwise(F.array_join(F.when(gone > 0, F.concat(kept, F.array(note))).otherwise(kept), "\n\n"))


def choose_level(maps: DataFrame, budget: int, tokens=rough_tokens) -> DataFrame:
    """Richest of ``signatures``, ``names`` and ``tree`` columns that fits, cut
    to the budget if even the tree does not; budget 0 takes signatures."""
    fits = lambda c: (tokens(F.col(c)) <= budget) | F.lit(budget == 0)
    level = F.when(fits("signatures"), "signatures").when(fits("names"), "names").otherwise("tree")
    d = maps.withColumn("level", level)
    chosen = F.when(F.col("level") == "signatures", F.col("signatures")).when(F.col("level") == "names", F.col("names")).otherwise(F.col("tree"))
    d = d.withColumn("map", chosen).withColumn("truncated", ~F.lit(budget == 0) & (tokens(F.col("map")) > budget))
    return d.withColumn("map", F.when(F.col("truncated"), cut(F.col("map"), budget, tokens)).otherwise(F.col("map"))) if budget else d
