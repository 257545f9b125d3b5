"""Token counts and costs by model."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Model, encoding, accuracy, dollars per token.
MODELS = [
    ("gpt-4o", "o200k_base", "exact", 5e-6),
    ("gpt-4o-mini", "o200k_base", "exact", 6e-7),
    ("claude-sonnet", "cl100k_base", "approximate", 3e-6),
    ("claude-haiku", "cl100k_base", "approximate", 8e-7),
]
FALLBACK = ("cl100k_base", "approximate", 5e-6)


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, encoding string, accuracy string, price double")


def with_model(df: DataFrame, model_col: str = "model") -> DataFrame:
    """Adds encoding, accuracy and price; unknown models get the fallback."""
    known = models(df.sparkSession).withColumnRenamed("model", model_col)
    d = df.join(F.broadcast(known), model_col, "left")  # four rows
    for c, v in zip(("encoding", "accuracy", "price"), FALLBACK, strict=True):
        d = d.withColumn(c, F.coalesce(c, F.lit(v)))
    return d


def cost(tokens: Column, price: Column) -> Column:
    return tokens * price


def cost_text(amount: Column) -> Column:
    return F.when(amount < 0.001, F.format_string("$%.4f¢", amount * 100)).otherwise(F.format_string("$%.4f", amount))


def bpe_counter(path: str):
    """A Column function that counts the tokens of a ``tokenizers`` file; 0 for
    blank text.  The vocabulary is loaded once per Python worker."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for texts in batches:
            yield texts.map(lambda x: 0 if x is None or not x.strip() else len(t.encode(x, add_special_tokens=False).ids))

    return count
