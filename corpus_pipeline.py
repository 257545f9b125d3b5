"""A corpus pipeline of five stages over the ``documents`` table.

Each stage works on all rows its predecessor kept and returns the columns of
documents, the last one the packed pieces.  Between stages the rows are written
as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextlake.llm import langid, mixing, neardup, packing, pii, queries, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Texts of whose letter trigrams the languages' texts hold less than this share are
#: in none of them.  The cosine's noise, 0.044 at 512 dimensions, is no such bound.
LEAST_SEEN = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows without letters or unlike every language go; ``lang``
    becomes the predicted language where it was null.

    Null and empty texts have no letters and go.  Null ids, repeated rows and very
    long texts are ordinary; columns beyond those of documents are dropped here and
    in every later stage, whatever their names.  No documents give none.
    """
    train = docs.filter(~langid.held_out())
    out = langid.identify(docs, langid.prototypes(train), keep=tuple(COLUMNS), known=langid.learned(train))
    accepted = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("seen") >= LEAST_SEEN)
    return out.filter(accepted).withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates on five-word shingles: one document of each group stays,
    that with the smallest id, rows without one last.

    Documents of fewer than five words are one shingle: equal ones are a group.
    Rows that repeat id and text are one document.  An id with several texts is
    several documents, none of which goes for its id.  Wordless and null texts are
    in no group and stay.  No documents give none.
    """
    return neardup.survivors(docs, shingle_words=5, pct=80).select(COLUMNS)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: every span is replaced by its kind, and ``n_chars`` is the new length.

    All rows stay, repeated ones and those with null ids too; an empty text stays
    empty and a null one null.  No documents give none.
    """
    found, _ = pii.find(docs.select(COLUMNS))
    out = found.withColumn("text", pii.masked("text", "spans"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document stands as often as the mix takes it.

    A null source is a source.  Rows that repeat an id and a text are taken one by
    one.  Empty and null texts hold no words: they stand by their certain copies
    only.  No documents give none.
    """
    taken = mixing.pareto_mix(docs, keep=tuple(COLUMNS[1:]))
    return taken.filter("copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all texts: a row per piece.

    A null text is empty and gives the end id alone; every copy of a document is a
    document of its own, with the same doc_id.  No documents give no pieces.
    """
    return packing.packed_documents(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("pii", mask),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot express the learned and tokenising stages; the tests hold every stage to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    previous: list[str] = []
    for i, (name, apply) in enumerate(STAGES):
        with scratch.scope() as paths:
            docs = apply(spark, docs, sf_dir)
            if i == len(STAGES) - 1:
                break
            docs = scratch.table(docs, name)
        scratch.sweep(previous + paths[:-1])
        previous = paths[-1:]
    return docs
