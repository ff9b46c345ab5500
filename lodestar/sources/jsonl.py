"""Corpus and query files: one JSON object a line, blank lines skipped, broken ones refused with their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS = "id string, articleSlug string, ordinalInArticle int, text string, embedding array<float>"
QUERIES = "id string, text string, expectedArticleSlug string, embedding array<float>"


class BrokenLine(ValueError):
    pass


def read(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def validate(spark: SparkSession, path: str, schema: str = CORPUS) -> None:
    """Raise BrokenLine with file and text of the first line that doesn't parse."""
    parsed = F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.input_file_name().alias("_file"), parsed.alias("p"))
    bad = lines.where("p is null or p._broken is not null").select("_file", F.col("value").alias("_broken")).head()
    if bad is not None:
        raise BrokenLine(f"{bad['_file']}: {bad['_broken'][:200]}")


def write(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)
