"""File tables: what a workspace scan reads, and where indexes go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions of source files and folders that are left out.
EXTENSIONS = "ts tsx js jsx mjs cjs py java go rs cs php rb kt swift vue svelte c cpp h hpp".split()
EXCLUDED = ["node_modules", "out", "dist", "build", ".git", ".vscode-test", "coverage", ".next", "__pycache__"]


def read_files(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS, excluded: list[str] = EXCLUDED, most: int | None = None) -> DataFrame:
    """(rel_path, size_bytes, body) of source files below ``root``; ``most``
    keeps the first by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    rel = F.regexp_replace(F.col("path"), r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    out = files.select(rel.alias("rel_path"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("body"))
    for folder in excluded:
        out = out.filter(~F.concat(F.lit("/"), "rel_path").contains(f"/{folder}/"))
    return out.orderBy("rel_path").limit(most) if most else out


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").partitionBy("model_id").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
