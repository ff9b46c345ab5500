"""Plans over catalog tables: active indexes, child counts, retention, parameter drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMITS = {"buckets": 5000, "indexes": 5000, "all": 10_000, "segments": 4096, "manifests": 1024, "keys": 5000}


def active(rows: DataFrame, limit: int = 5000, key: str = "bucket_id") -> DataFrame:
    """Rows that aren't deleted, oldest first."""
    return rows.where(F.col("deleted_at").isNull()).orderBy("created_at", key).limit(limit)


def active_indexes(indexes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Active indexes of active buckets."""
    up = buckets.where(F.col("deleted_at").isNull()).select("bucket_id")
    return active(indexes.join(up, "bucket_id", "left_semi"), LIMITS["all"], "index_id")


def child_counts(buckets: DataFrame, indexes: DataFrame) -> DataFrame:
    """Indexes of each bucket, in any state."""
    n = indexes.groupBy("bucket_id").agg(F.count("*").alias("children"))
    return buckets.select("bucket_id").join(n, "bucket_id", "left").select("bucket_id", F.coalesce("children", F.lit(0)).alias("children"))


def deletable_buckets(buckets: DataFrame, indexes: DataFrame) -> DataFrame:
    """Active buckets without active indexes."""
    live = indexes.where(F.col("deleted_at").isNull()).select("bucket_id")
    return buckets.where(F.col("deleted_at").isNull()).join(live, "bucket_id", "left_anti")


def expired(rows: DataFrame, before: Column) -> DataFrame:
    """Rows deleted strictly before the end of the window."""
    return rows.where(F.col("deleted_at").isNotNull() & (F.col("deleted_at") < before))


def expired_buckets(buckets: DataFrame, indexes: DataFrame, before: Column) -> DataFrame:
    """Expired buckets without children once expired indexes are gone."""
    left = indexes.join(expired(indexes, before).select("index_id"), "index_id", "left_anti")
    return expired(buckets, before).join(left.select("bucket_id"), "bucket_id", "left_anti")


def params_drift(indexes: DataFrame, m: int = 16, add_hierarchy: bool = False) -> DataFrame:
    """Indexes whose stored m or addHierarchy differ from the defaults, and those whose parameters don't parse."""
    p = F.from_json("engine_params", "m int, addHierarchy boolean, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = indexes.withColumn("p", p)
    state = F.when(F.col("p._broken").isNotNull() | F.col("p").isNull(), "unreadable").when((F.coalesce("p.m", F.lit(m)) != m) | (F.coalesce("p.addHierarchy", F.lit(add_hierarchy)) != add_hierarchy), "drifted")
    return rows.select("index_id", state.alias("state")).where("state is not null")
