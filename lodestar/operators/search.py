"""Filtered nearest-neighbour search over the rows of active segments.

Rows: id, segment_id, ordinal, vector, attributes.  Ties: score descending,
then id, segment_id, ordinal.  All active segments are one scan; filters and
deletes apply before scoring, scoring before top-k, and attributes are
fetched only for the hits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import METRICS, rounded, row_scores, score, scores
from ..plans.filters import Expr, parse, to_column

#: Bytes of query vectors that are broadcast at once; more queries go in blocks of that size.
QUERY_BYTES = 32 << 20
#: Ids of a delete set that is broadcast; a larger one is shuffled.
BROADCAST_IDS = 1_000_000


def best() -> list[Column]:
    return [F.desc("score"), F.asc("id"), F.asc("segment_id"), F.asc("ordinal")]


class DimensionMismatch(ValueError):
    code = "dimension_mismatch"


def check_dimension(query: Sequence[float], dimension: int) -> None:
    if len(query) != dimension:
        raise DimensionMismatch(f"the query has {len(query)} dimensions, the index {dimension}")


def few(df: DataFrame, n: int = BROADCAST_IDS) -> bool:
    return df.limit(n + 1).count() <= n


def without(rows: DataFrame, gone: DataFrame | None, on: list[str]) -> DataFrame:
    """rows less those in gone; a small delete set is broadcast, a large one shuffled."""
    if gone is None:
        return rows
    gone = gone.select(*on).distinct()
    return rows.join(F.broadcast(gone) if few(gone) else gone, on, "left_anti")


def accepted(rows: DataFrame, where: dict | Expr | None = None, tombstones: DataFrame | None = None, staged: DataFrame | None = None, attribute=None) -> DataFrame:
    """Rows that pass the filter and aren't deleted: persisted deletes by (segment_id, ordinal), staged ones by id."""
    e = parse(where) if where is None or isinstance(where, dict) else where
    if e is not None:
        rows = rows.where(to_column(e, attribute) if attribute else to_column(e))
    return without(without(rows, tombstones, ["segment_id", "ordinal"]), staged, ["id"])


def scored(rows: DataFrame, query: Sequence[float], metric: str = "COSINE", threshold: float = 0.0, rerank_floor: float = 0.0, vector: str = "vector") -> DataFrame:
    """Scores of all rows; an exact engine applies both cut-offs to the exact score."""
    low = max(threshold, rerank_floor)
    out = rows.withColumn("score", score(F.col(vector), query, metric)).where(F.col("score").isNotNull())
    return out.where(F.col("score") >= low) if low > 0 else out


def fitting(rows: DataFrame, dimension: int, vector: str = "vector") -> DataFrame:
    """Rows whose vector has the dimension and no nulls; others have no score."""
    return rows.where((F.size(vector) == dimension) & ~F.exists(vector, lambda x: x.isNull()))


def nearest(rows: DataFrame, query: Sequence[float], k: int = 10, metric: str = "COSINE", threshold: float = 0.0, rerank_floor: float = 0.0, decimals: int | None = None) -> DataFrame:
    """id, segment_id, ordinal and score of the k best: scored in Arrow batches, of which each passes on its k best (and their ties).

    With ``decimals`` hits are ranked by the rounded score, so that scores alike to that digit go by id; the cut-offs are by the exact one.
    """
    low, q = max(threshold, rerank_floor), np.asarray(query, dtype=float)
    shared = rows.sparkSession.sparkContext.broadcast(q)
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")

    def best_of(batches):
        q = shared.value
        for b in batches:
            s = row_scores(b.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), len(q)), q, metric)
            ok = np.flatnonzero(s >= low if low > 0 else ~np.isnan(s))
            s = s if decimals is None else rounded(s, decimals)
            if len(ok) > k:
                ok = ok[s[ok] >= np.partition(s[ok], len(ok) - k)[len(ok) - k]]
            at = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(s[ok])], names=["id", "segment_id", "ordinal", "score"])

    hits = fitting(rows, len(q)).select("id", "segment_id", F.col("ordinal").cast("long").alias("ordinal"), "vector").mapInArrow(best_of, "id string, segment_id string, ordinal long, score double")
    return top_k(hits, k)


def top_k(hits: DataFrame, k: int, decimals: int | None = None) -> DataFrame:
    """The k best of all segments, by the rounded score if ``decimals`` are given."""
    hits = hits if decimals is None else hits.withColumn("score", F.round("score", decimals))
    return hits.orderBy(*best()).limit(k)


def top_k_per_segment(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("segment_id").orderBy(*best()))).where(F.col("rank") <= k)


def two_phase(rows: DataFrame, query: Sequence[float], k: int, rerank_k: int, proxy: Column, metric: str = "COSINE", decimals: int | None = None) -> DataFrame:
    """The best rerank_k by a cheap score, of these the k best by the exact one."""
    pool = rows.withColumn("_proxy", proxy).orderBy(F.desc("_proxy"), "id", "segment_id", "ordinal").limit(max(rerank_k, k))
    return top_k(scored(pool.drop("_proxy"), query, metric), k, decimals)


def two_phase_whole(rows: DataFrame, query: Sequence[float], k: int, rerank_k: int, head: int, metric: str = "COSINE", decimals: int | None = None) -> DataFrame:
    """The k best by cosine, all of them: the first phase bounds each score by the first ``head`` dimensions and the lengths of the rest.

    The rerank_k rows of the highest bounds give the k-th score to reach; every row whose bound reaches it is scored, however many they are.
    """
    if metric != "COSINE":
        raise ValueError(f"no bound for {metric}")
    q = np.asarray(query, float)
    square = lambda v: 2 * score(v, v, "DOT_PRODUCT") - 1
    rest = F.slice("vector", head + 1, max(1, len(q) - head))
    most = 2 * score(F.slice("vector", 1, head), q[:head].tolist(), "DOT_PRODUCT") - 1 + F.sqrt(F.greatest(square(rest), F.lit(0.0))) * float(np.sqrt(q[head:] @ q[head:]))
    bound = (1 + F.try_divide(most, F.sqrt(square(F.col("vector"))) * float(np.sqrt(q @ q)))) / 2
    bounded = rows.withColumn("_bound", bound)
    pool = bounded.orderBy(F.desc("_bound"), "id", "segment_id", "ordinal").limit(max(rerank_k, k))
    got = [r[0] for r in top_k(scored(pool, query, metric), k).select("score").collect()]
    if len(got) == k and k:
        bounded = bounded.where(F.col("_bound") >= got[-1] - 1e-9 - (0 if decimals is None else 10.0**-decimals))
    return top_k(scored(bounded.drop("_bound"), query, metric), k, decimals)


def enrich(hits: DataFrame, rows: DataFrame) -> DataFrame:
    """Attributes of the hits by (segment_id, ordinal); an empty map if there are none.  hits are at most k rows."""
    side = rows.select("segment_id", "ordinal", "attributes")
    hits = hits.drop("attributes")
    found = side.join(F.broadcast(hits.select("segment_id", "ordinal").distinct()), ["segment_id", "ordinal"], "left_semi")
    return hits.join(found, ["segment_id", "ordinal"], "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def search(rows: DataFrame, query: Sequence[float], k: int = 10, metric: str = "COSINE", where: dict | None = None, tombstones: DataFrame | None = None,
           staged: DataFrame | None = None, threshold: float = 0.0, rerank_floor: float = 0.0) -> DataFrame:
    """id, segment_id, ordinal, score and attributes of the k best."""
    return enrich(nearest(accepted(rows, where, tombstones, staged), query, k, metric, threshold, rerank_floor), rows)


def search_many(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "COSINE", decimals: int = 9) -> DataFrame:
    """qid, rank, id, segment_id, ordinal, score for each row (qid, vector) of queries.

    Blocks of queries are broadcast and multiplied with Arrow batches of vectors; each batch passes on only its k
    best a query, so what is shuffled doesn't grow with the dimension.  Ranks are by the score rounded to ``decimals``.
    Queries have one dimension; vectors of another, or with nulls, are no hits.
    """
    spark = rows.sparkSession
    out, block, used = None, [], 0

    def run(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([q for q, _ in block], dtype=object), np.array([v for _, v in block], dtype=float)))

        def multiply(batches):
            qids, vectors = shared.value
            for b in batches:
                if not len(b):
                    continue
                own = b.column(3)
                s = np.round(scores(own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1), vectors, metric), decimals)
                ids = np.asarray(b.column(0).to_pylist(), dtype=object)
                least = np.sort(np.where(np.isnan(s), -np.inf, s), axis=0)[max(0, len(b) - k)]
                r, c = np.nonzero(s >= least)  # ties of the k-th stay
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qids[c].tolist(), type=pa.int64()), pa.array(ids[r].tolist(), type=pa.string()), b.column(1).take(pa.array(r)), b.column(2).take(pa.array(r)), pa.array(s[r, c])],
                    names=["qid", "id", "segment_id", "ordinal", "score"],
                )

        return fitting(rows, len(block[0][1])).select("id", "segment_id", F.col("ordinal").cast("long"), "vector").mapInArrow(multiply, "qid long, id string, segment_id string, ordinal long, score double")

    for r in queries.select("qid", "vector").toLocalIterator():
        block.append((r["qid"], r["vector"]))
        used += 8 * len(r["vector"])
        if used >= QUERY_BYTES:
            out = run(block) if out is None else out.unionByName(run(block))
            block, used = [], 0
    if block or out is None:
        if not block:
            return spark.createDataFrame([], "qid long, rank int, id string, segment_id string, ordinal long, score double")
        out = run(block) if out is None else out.unionByName(run(block))
    w = W.partitionBy("qid").orderBy(*best())
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", "segment_id", "ordinal", "score")


def filtered_ratio(rows: DataFrame, where: dict | None, tombstones: DataFrame | None = None, staged: DataFrame | None = None) -> DataFrame:
    """segment_id, rows, accepted ones and their share."""
    passed = accepted(rows, where, tombstones, staged).groupBy("segment_id").agg(F.count("*").alias("accepted"))
    size = rows.groupBy("segment_id").agg(F.count("*").alias("size"))
    return size.join(passed, "segment_id", "left").select("segment_id", "size", F.coalesce("accepted", F.lit(0)).alias("accepted"), (F.coalesce("accepted", F.lit(0)) / F.col("size")).alias("ratio"))
