"""Session log: recency by key, totals, history and savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WITHIN_SECONDS = 600


def key(kind: str, *parts: Column) -> Column:
    """``file:``, ``imports:``, ``types:``, ``diff:``, ``repo-map:`` and ``auto:``
    take one part, ``symbol:`` and ``class:`` a file and a name."""
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("#", *parts))


def recent(entries: DataFrame, within: int = WITHIN_SECONDS) -> DataFrame:
    """Adds ``seconds_ago``: the age of the latest earlier entry of the session
    with the key, if at most ``within`` seconds; and ``minutes`` for the note."""
    order = Window.partitionBy("session", "key").orderBy("ts", "entry_id")
    seconds = F.col("ts").cast("timestamp").cast("double")
    gap = seconds - F.lag(seconds).over(order)
    d = entries.withColumn("gap", gap).withColumn("seconds_ago", F.when(F.col("gap") <= within, F.floor(F.col("gap") + 0.5).cast("long")))
    return d.withColumn("minutes", F.greatest(F.lit(1), F.floor(F.col("seconds_ago") / 60 + 0.5)).cast("long")).withColumn("minutes", F.when(F.col("seconds_ago").isNotNull(), F.col("minutes"))).drop("gap")


def totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("session").agg(F.count(F.lit(1)).alias("entries"), F.sum("context_tokens").alias("context_tokens"), F.sum("total_tokens").alias("total_tokens"))


def history(entries: DataFrame, most: int) -> DataFrame:
    """The latest entries of each session, newest first."""
    order = Window.partitionBy("session").orderBy(F.col("ts").desc(), F.col("entry_id").desc())
    return entries.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)


def describe(ts: Column, kind: Column, tokens: Column, keys: Column) -> Column:
    more = F.when(F.size(keys) > 1, F.concat(F.lit(" (+"), (F.size(keys) - 1).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return F.concat_ws(" · ", F.date_format(ts, "HH:mm:ss"), kind, F.concat(tokens.cast("string"), F.lit(" tokens")), F.concat(F.get(keys, F.lit(0)), more))


def savings(entries: DataFrame) -> DataFrame:
    """Per session: what was saved, entries that saved nothing aside."""
    return entries.filter("tokens_saved > 0").groupBy("session").agg(F.sum("tokens_saved").alias("tokens_saved"), F.count(F.lit(1)).alias("optimizations"), F.min("ts").alias("first_used"), F.max("ts").alias("last_used"))
