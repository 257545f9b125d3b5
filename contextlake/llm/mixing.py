"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources share a multiple of all sizes by weight, none above its
limit (a multiple of its own size); what is cut off is shared again by weight.
That is a level ``t`` with ``target = min(limit, weight * t)``, found from one
ordered pass over the sources, not by repetition.

Samples: a document is expected ``min(limit, level * priority)`` times, at one
level per source, so documents differ in their inclusion probabilities and what
those at the limit cannot take goes to the others.  Its whole copies are certain;
the remaining fraction is its probability of one more.  Documents are ranked by
random odds over inclusion odds, and the first ones whose sizes make up the
remaining target are taken.  The cut in that order is found by two histograms of
ranks, so no task ever sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.llm import scratch

BUCKETS = 512
#: Priority classes per doubling, by which the level of a source is found.
CLASSES = 64


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source_col: str, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Weights repeat over the sources by code point, null last.  A source of size
    0 has target 0.  One task sorts one row of some 40 bytes per source: this is
    meant for up to some ten million sources, and spills where they are many.
    """
    by_name = Window.orderBy(F.col(source_col).isNull(), F.col(source_col))
    level = Window.orderBy(F.col("full"), F.col("nth"))
    nth = (F.row_number().over(by_name) - 1).alias("nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy()
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.select(source_col, "source_size", nth)
        .withColumn("w", weight)
        .withColumn("cap", F.col("source_size") * limit)
        .withColumn("full", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(all_rows) * share)
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("open"))
    )
    # in order of cap/weight, the first source that its level does not fill fixes the level of all after it
    fixed = F.min(F.when(F.col("level") < F.col("full"), F.struct("full", "nth", "level"))).over(all_rows)["level"]
    out = ranked.withColumn("fixed", fixed).withColumn("target", F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("fixed"))))
    return out.select(source_col, "source_size", F.col("target").cast("double").alias("target"))


def _cut(rows: DataFrame, nth: str) -> DataFrame:
    """(_key, cut, below): the bucket in which a source's running size reaches
    ``rest``, and the size of the buckets before it.  The window has a row per
    bucket, not per document."""
    sums = rows.groupBy("_key", nth).agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
    running = Window.partitionBy("_key").orderBy(nth)
    found = sums.withColumn("upto", F.sum("s").over(running)).withColumn("below", F.col("upto") - F.col("s"))
    return found.filter("below < rest and upto >= rest").select("_key", F.col(nth).alias("cut_" + nth), F.col("below").alias("below_" + nth))


def _levels(rows: DataFrame, goal: DataFrame, limit: float) -> DataFrame:
    """(_key, level): the level at which a source's documents, each expected
    ``min(limit, level * _w)`` times, make up its target; null where all are at the limit.

    Priorities are taken by class, so a window has a row per source and class.
    """
    by_class = rows.filter("size > 0").groupBy("_key", F.floor(F.log2("_w") * CLASSES).alias("c")).agg(F.sum("size").alias("s"), F.sum(F.col("size") * F.col("_w")).alias("m"))
    falling = Window.partitionBy("_key").orderBy(F.desc("c"))
    before = F.coalesce(F.sum("s").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_mass = F.sum("m").over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = by_class.join(goal.select("_key", "target"), "_key").withColumn("level", (F.col("target") - before * limit) / open_mass)
    below = tried.filter(F.col("level") * F.col("m") / F.col("s") < limit)
    return below.groupBy("_key").agg(F.max(F.struct("c", "level")).alias("f")).select("_key", F.greatest("f.level", F.lit(0.0)).alias("level"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_nth``: 0 for a row that is unlike all others, else its number
    among the rows of equal source and hash of id and text.

    Rows are numbered within the partitions they were written in, and partitions
    by running sums of their counts, so no window holds a group of equal rows.
    """
    rows = rows.withColumn("_e", F.xxhash64("_h", "_key")).withColumn("_part", F.shiftright("_row", 33))
    equal = rows.groupBy("_e").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("_e")
    equal = scratch.table(equal, "equal")
    if equal.isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("long")).drop("_e", "_part")
    parts = rows.join(equal, "_e", "left_semi").groupBy("_e", "_part").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("_e").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = scratch.table(parts.select("_e", "_part", F.coalesce(before, F.lit(0)).alias("_before")), "repeated")
    joined = rows.join(parts, ["_e", "_part"], "left")
    inside = F.row_number().over(Window.partitionBy("_e", "_part").orderBy("_row")) - 1
    again = joined.filter("_before is not null").withColumn("_nth", F.col("_before") + inside)
    return scratch.table(joined.filter("_before is null").withColumn("_nth", F.lit(0).cast("long")).unionByName(again).drop("_e", "_part", "_before"), "numbered")


def pareto_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 17,
    keep: tuple[str, ...] = (),
    priority: Column | None = None,
) -> DataFrame:
    """(id, size, source_size, target, copies, taken, ``keep`` columns) of every document.

    ``copies`` is the number of times the mix takes the document and ``taken``
    the words of that; no document has more than ceil(limit) copies, and none of
    size 0 has any beyond the certain ones.  The sampled words of a source miss what
    remains of its target by at most half of the document at the cut.
    ``priority``: how often a document is wanted against others of its source
    (positive, null as 1); by default log2(1 + words), so that a document of a
    thousand words is wanted about three times as often as one of ten.

    Random numbers are a hash of seed, id and text, and for rows that repeat both of
    their number among these too, so they are taken or left one by one; reruns
    agree.  Null ids, texts and sources are ordinary values, and an empty table
    gives an empty one.
    """
    extra = {c: F.col(c) for c in keep}
    size = word_count(F.col(text_col))
    priority = F.log2(1.0 + size) if priority is None else priority.cast("double")
    priority = F.least(F.greatest(F.coalesce(priority, F.lit(1.0)), F.lit(1e-9)), F.lit(1e9))
    number = F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col)))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("_key")
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), key, size.alias("size"), number.alias("_h"), priority.alias("_w"), *[c.alias(f"_keep_{n}") for n, c in extra.items()]
    )
    slim = scratch.table(rows.withColumn("_row", F.monotonically_increasing_id()), "sizes")
    per_source = scratch.table(slim.groupBy("_source", "_key").agg(F.sum("size").alias("source_size")), "sources")
    goal = targets(per_source, "_source", weights, share, limit)
    goal = scratch.table(goal.select(F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")).alias("_key"), "source_size", "target"), "targets")
    level = scratch.table(_levels(slim, goal, limit), "levels")
    # The tables of targets and levels have a row per source; Spark broadcasts them while they are small and otherwise joins by shuffle.
    wanted = (
        _numbered(slim)
        .join(goal, "_key")
        .join(level, "_key", "left")
        .withColumn("_times", F.when(F.col("source_size") > 0, F.least(F.coalesce(F.col("level") * F.col("_w"), F.lit(limit)), F.lit(limit))).otherwise(0.0))
        .withColumn("_whole", F.floor("_times").cast("long"))
        .withColumn("_p", F.least(F.col("_times") - F.col("_whole"), F.lit(1 - 1e-12)))
    )
    certain = wanted.groupBy("_key").agg(F.sum(F.col("size") * F.col("_whole")).alias("_certain"))
    certain = scratch.table(certain, "certain")
    bits = F.shiftrightunsigned(F.when(F.col("_nth") > 0, F.xxhash64("_h", "_nth")).otherwise(F.col("_h")), 11)
    wanted = (
        wanted.join(certain, "_key")
        .withColumn("rest", F.col("target") - F.col("_certain"))
        .withColumn("_u", F.least((bits.cast("double") + 0.5) / F.lit(float(1 << 53)), F.lit(1 - 1e-15)))
        .withColumn("_q", F.col("_u") / (1 - F.col("_u")) / (F.greatest("_p", F.lit(1e-12)) / (1 - F.col("_p"))))
    )
    # ranks fall into buckets by q / (1 + q), which runs from 0 to 1
    place = F.col("_q") / (1 + F.col("_q")) * BUCKETS
    wanted = wanted.withColumn("b1", F.floor(place).cast("int")).withColumn("b2", F.floor((place - F.floor(place)) * BUCKETS).cast("int"))
    sampled = wanted.filter("size > 0 and rest > 0 and _p > 0")
    first = scratch.table(_cut(sampled.select("_key", "b1", "size", "rest"), "b1"), "cut")
    inside = sampled.join(first, "_key").filter("b1 = cut_b1")
    second = scratch.table(_cut(inside.select("_key", "b2", "size", (F.col("rest") - F.col("below_b1")).alias("rest")), "b2"), "cut")
    cuts = scratch.table(first.join(second, "_key"), "cuts")
    # in the last bucket of each source: documents in order, the one at the cut where that comes nearer
    last = inside.join(second, "_key").filter("b2 = cut_b2")
    order = Window.partitionBy("_key").orderBy("_q", "_h", "_id", "_nth")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = last.withColumn("_upto", upto + F.col("below_b1") + F.col("below_b2"))
    at = F.struct("_q", "_h", "_id", "_nth")
    edge = scratch.table(reached.filter(F.col("_upto") - F.col("size") / 2 <= F.col("rest")).groupBy("_key").agg(F.max(at).alias("edge")), "edge")
    chosen = (
        wanted.join(cuts, "_key", "left")
        .join(edge, "_key", "left")
        .withColumn(
            "_more",
            F.when((F.col("size") <= 0) | (F.col("rest") <= 0) | (F.col("_p") <= 0), 0)
            .when(F.col("cut_b1").isNull(), 1)
            .when(F.col("b1") != F.col("cut_b1"), (F.col("b1") < F.col("cut_b1")).cast("int"))
            .when(F.col("b2") != F.col("cut_b2"), (F.col("b2") < F.col("cut_b2")).cast("int"))
            .otherwise(F.coalesce((at <= F.col("edge")).cast("int"), F.lit(0))),
        )
    )
    copies = (F.col("_whole") + F.col("_more")).alias("copies")
    return chosen.select(F.col("_id").alias(id_col), "size", "source_size", "target", copies, (F.col("size") * copies).alias("taken"), *[F.col(f"_keep_{n}").alias(n) for n in keep])
