"""Point lookup, deletes and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import few


def get(rows: DataFrame, ids: list[str], tombstones: DataFrame | None = None, staged: DataFrame | None = None, spark=None) -> DataFrame:
    """id, found and attributes for each id asked for.

    The first match in manifest order decides: if it is deleted the id isn't found, whatever newer segments hold.
    """
    asked = rows.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(ids)], "id string")
    w = W.partitionBy("id").orderBy("manifest_pos", "ordinal")
    first = rows.where(F.col("id").isin(list(ids))).withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "segment_id", "ordinal", "attributes")
    if tombstones is not None:
        first = first.join(tombstones.select("segment_id", "ordinal").distinct(), ["segment_id", "ordinal"], "left_anti")
    if staged is not None:
        first = first.join(staged.select("id").distinct(), "id", "left_anti")
    return asked.join(first.select("id", "attributes", F.lit(True).alias("found")), "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"), "attributes")


def find_ordinal(rows: DataFrame, wanted: str) -> DataFrame:
    """The first ordinal of an id by segment."""
    return rows.where(F.col("id") == wanted).groupBy("segment_id").agg(F.min("ordinal").alias("ordinal"))


def ordinals_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """All (segment_id, ordinal, id) whose id is among ids."""
    ids = ids.select("id").distinct()
    return rows.select("segment_id", "ordinal", "id").join(F.broadcast(ids) if few(ids) else ids, "id", "left_semi")


def merge_tombstones(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("segment_id", "ordinal").union(new.select("segment_id", "ordinal")).distinct()


def stage(staged: DataFrame, ids: DataFrame) -> DataFrame:
    """staged with the ids that it lacks."""
    new = ids.select("id").distinct().join(staged, "id", "left_anti")
    return staged.select("id").union(new)


def stats(segments: DataFrame, pending: Column | int = 0) -> DataFrame:
    """Segments, vectors and bytes; deleted and repeated vectors count."""
    return segments.agg(F.count("*").alias("segment_count"), F.coalesce(F.sum("vector_count"), F.lit(0)).alias("vector_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("pending", F.lit(pending).cast("long"))


def active_segments(manifests: DataFrame, segments: DataFrame) -> DataFrame:
    """index_id, position and row of the segments of the latest manifest, those without a row dropped."""
    latest = manifests.groupBy("index_id").agg(F.max_by("segment_ids", "version").alias("ids"), F.max("version").alias("version"))
    at = latest.select("index_id", "version", F.posexplode(F.from_json("ids", "array<string>")).alias("pos", "segment_id"))
    return at.join(segments.drop("index_id"), "segment_id").select("index_id", "version", "pos", "segment_id", "vector_count", "bytes")
