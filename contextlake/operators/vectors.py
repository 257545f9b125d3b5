"""Cosine search, text chunks and the incremental index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextlake.functions.text import js_trim

MIN_CHARS, MAX_CHARS, WINDOW_LINES, OVERLAP_LINES = 30, 4000, 200, 20


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a vector is zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a.cast("array<double>"), F.lit(1), n), F.slice(b.cast("array<double>"), F.lit(1), n)
    norm = F.sqrt(_sum(F.transform(x, lambda v: v * v))) * F.sqrt(_sum(F.transform(y, lambda v: v * v)))
    return F.when(norm > 0, _sum(F.zip_with(x, y, lambda p, q: p * q)) / norm).otherwise(F.lit(0.0))


def normalise(v: Column) -> Column:
    d = v.cast("array<double>")
    norm = F.sqrt(_sum(F.transform(d, lambda x: x * x)))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


#: Queries that are broadcast at a time.
QUERY_BLOCK = 2000


def search(index: DataFrame, queries: DataFrame, n: int = 5, least: float = 0.2) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's n best with at least ``least``.

    ``queries`` (query_id, query) is a stated set, which meets all rows in blocks of
    about ``QUERY_BLOCK``: its size is counted, and no more is broadcast at once.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [index.crossJoin(F.broadcast(queries.filter(block == i) if blocks > 1 else queries)) for i in range(blocks)]
    met = parts[0]
    for part in parts[1:]:
        met = met.unionByName(part)
    scored = met.select("query_id", "vec_id", cosine(F.col("embedding"), F.col("query")).alias("score")).filter(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")


def chunk_windows(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES, least: int = MIN_CHARS) -> DataFrame:
    """(id, chunk_no, start_line, end_line, text, content_hash).

    A chunk below ``least`` characters joins the one before it; empty leading
    ones go; nothing follows the chunk that reaches the last line.  Ids must be
    unique; a null or blank text has no chunks.
    """
    step = max(1, window - max(0, min(overlap, window - 1)))
    lines = files.select(F.col(id_col).alias("id"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    starts = F.expr(f"sequence(0, size(lines) - 1, {step})")
    w = lines.select("id", F.size("lines").alias("n"), F.explode(starts).alias("start"), "lines")
    w = w.select("id", "n", "start", F.least(F.col("start") + window, F.col("n")).alias("stop"), js_trim(F.array_join(F.slice("lines", F.col("start") + 1, F.lit(window)), "\n")).alias("t"))
    order = Window.partitionBy("id").orderBy("start")
    w = w.withColumn("first", F.min(F.expr("case when t <> '' then start end")).over(Window.partitionBy("id")))
    w = w.withColumn("push", F.expr(f"t <> '' and (length(t) >= {least} or start = first)"))
    w = w.withColumn("done", F.coalesce(F.max(F.expr("push and stop = n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).filter("not done and start >= first")
    w = w.withColumn("chunk_no", F.sum(F.col("push").cast("int")).over(order).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "t"))), lambda x: x["t"]), "\n")
    out = w.groupBy("id", "chunk_no").agg(F.min("start").cast("long").alias("start_line"), (F.max("stop") - 1).cast("long").alias("end_line"), text.alias("text"))
    return out.withColumn("content_hash", F.sha1(F.encode("text", "UTF-8"))).withColumnRenamed("id", id_col)


def chunk_symbols(symbols: DataFrame, least: int = MIN_CHARS, most: int = MAX_CHARS, window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> DataFrame:
    """(rel_path, symbol_name, start_line, end_line, text): a symbol is a chunk,
    or numbered windows of its lines if it is long."""
    step = max(1, window - overlap)
    s = symbols.withColumn("t", js_trim(F.col("body"))).filter(F.length("t") >= least)
    whole = s.filter(F.length("t") <= most).select("rel_path", F.col("name").alias("symbol_name"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("t").alias("text"))
    long_ = s.filter(F.length("t") > most).withColumn("lines", F.split("t", "\n", -1)).withColumn("at", F.explode(F.expr(f"sequence(0, size(lines) - 1, {step})")))
    long_ = long_.filter(F.expr(f"at = 0 or at + {window - step} < size(lines)")).withColumn("text", js_trim(F.array_join(F.slice("lines", F.col("at") + 1, F.lit(window)), "\n")))
    long_ = long_.filter(F.length("text") >= least).withColumn("part", F.row_number().over(Window.partitionBy("rel_path", "name", "start_line").orderBy("at")))
    parts = long_.select(
        "rel_path", F.concat("name", F.lit("#"), F.col("part").cast("string")).alias("symbol_name"), (F.col("start_line") + F.col("at")).cast("long").alias("start_line"), F.least(F.col("end_line"), F.col("start_line") + F.col("at") + window - 1).cast("long").alias("end_line"), "text"
    )
    return whole.unionByName(parts)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action): keep where path, hash and model agree, else embed; drop
    what is only in the old index."""
    o = old.select("path", F.col("sha1").alias("old_sha1"), F.col("model_id").alias("old_model"))
    j = new.join(o, "path", "full_outer")
    action = F.when(F.col("sha1").isNull(), "drop").when((F.col("sha1") == F.col("old_sha1")) & (F.col("model_id") == F.col("old_model")), "keep").otherwise("embed")
    return j.select("path", action.alias("action"))


def hashing_embedder(dims: int = 64) -> Callable[[pd.Series], pd.Series]:
    """A stand-in for a model: signed word hashes, normalised.  Not semantic."""
    from zlib import crc32

    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[float]:
            v = np.zeros(dims)
            for word in (t or "").lower().split():
                h = crc32(word.encode())
                v[h % dims] += 1 if h >> 31 else -1
            norm = np.linalg.norm(v)
            return (v / norm if norm else v).tolist()

        return texts.map(one)

    return embed


def embed(df: DataFrame, text_col: str = "text", load: Callable[[], Callable[[pd.Series], pd.Series]] = hashing_embedder) -> DataFrame:
    """Adds ``embedding``; ``load`` makes the model once per Python worker."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield model(texts)

    return df.withColumn("embedding", run(F.col(text_col)))


def update_index(old: DataFrame, files: DataFrame, model_id: str, load=hashing_embedder) -> DataFrame:
    """The new index: chunks of unchanged files as they are, others embedded anew."""
    new = files.select("path", F.sha1(F.encode("body", "UTF-8")).alias("sha1"), F.lit(model_id).alias("model_id"))
    todo = changes(old.select("path", "sha1", "model_id").distinct(), new)
    kept = old.join(todo.filter("action = 'keep'").select("path"), "path", "left_semi")
    fresh = files.join(todo.filter("action = 'embed'").select("path"), "path", "left_semi")
    chunks = embed(chunk_windows(fresh, "path", "body")).join(new, "path")
    return kept.unionByName(chunks.select(*kept.columns))


def index_stats(index: DataFrame) -> DataFrame:
    return index.groupBy("model_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.countDistinct("path").alias("file_count"))
