"""Recall against ground truth, and checks of fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_top1(results: DataFrame) -> DataFrame:
    """Queries whose best hit has the expected class; results: qid, rank, expected, got."""
    return results.where("rank = 1").agg(F.count("*").alias("queries"), F.count_if(F.col("expected") == F.col("got")).alias("correct"))


def recall_majority(results: DataFrame, k: int) -> DataFrame:
    """Queries of whose k hits more than k / 2 (integer division) have the expected class."""
    by = results.where(F.col("rank") <= k).groupBy("qid").agg(F.count_if(F.col("expected") == F.col("got")).alias("n"))
    return by.agg(F.count("*").alias("queries"), F.count_if(F.col("n") > k // 2).alias("correct"))


def recall_at(truth: DataFrame, results: DataFrame) -> DataFrame:
    """Share of the true hits that were returned; queries without true hits don't count.  Both: qid, id."""
    truth = truth.select("qid", "id").distinct()
    hit = truth.join(results.select("qid", "id").distinct(), ["qid", "id"], "left_semi")
    return truth.agg(F.count("*").alias("truth")).crossJoin(hit.agg(F.count("*").alias("matched"))).withColumn("recall", F.try_divide("matched", "truth"))


def fixture_violations(corpus: DataFrame, queries: DataFrame, dimension: int) -> DataFrame:
    """Rule and number of offending rows: blank fields, wrong dimensions, values that aren't finite, repeated ids, unknown slugs."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    wild = F.coalesce(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    one = corpus.agg(
        F.count_if(blank("id")).alias("blank_id"), F.count_if(blank("text")).alias("blank_text"), F.count_if(blank("slug")).alias("blank_slug"),
        F.count_if(F.coalesce(F.size("embedding") != dimension, F.lit(True))).alias("wrong_dimension"), F.count_if(wild).alias("not_finite"),
    )
    two = corpus.groupBy("id").count().where("count > 1").agg(F.count("*").alias("repeated_id"))
    three = queries.join(corpus.select(F.col("slug").alias("expected")).distinct(), "expected", "left_anti").agg(F.count("*").alias("unknown_slug"))
    wide = one.crossJoin(two).crossJoin(three)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in wide.columns])).alias("x")).select("x.*")
