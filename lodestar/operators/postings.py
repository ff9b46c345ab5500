"""Inverted lists of attributes: (segment, key, value) to sorted ordinals, without keys of too many values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAP = 10_000


def exploded(rows: DataFrame) -> DataFrame:
    """segment_id, ordinal, key, value."""
    return rows.select("segment_id", "ordinal", F.explode("attributes").alias("key", "value"))


def key_cardinality(rows: DataFrame) -> DataFrame:
    return exploded(rows).groupBy("segment_id", "key").agg(F.count_distinct("value").alias("values"))


def skipped_keys(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """Keys with more than cap values in a segment; cap itself is indexed."""
    return key_cardinality(rows).where(F.col("values") > cap)


def indexed(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """Exploded rows of the keys that are indexed."""
    return exploded(rows).join(F.broadcast(skipped_keys(rows, cap).select("segment_id", "key")), ["segment_id", "key"], "left_anti")


def lists(rows: DataFrame, cap: int = CAP) -> DataFrame:
    return indexed(rows, cap).groupBy("segment_id", "key", "value").agg(F.sort_array(F.collect_list("ordinal")).alias("ordinals"), F.count("*").alias("n"))


def bitmaps(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """The same as bitmaps by bucket of ordinals: of bounded size however long a list is."""
    at = F.col("ordinal").cast("long")
    return (
        indexed(rows, cap).groupBy("segment_id", "key", "value", F.bitmap_bucket_number(at).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        .withColumn("n", F.bitmap_count("bits"))
    )


def indexed_keys(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """segment_id and the set of its indexed keys, what the choice between scan and lists goes by."""
    return key_cardinality(rows).where(F.col("values") <= cap).groupBy("segment_id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
