"""Optional approximate search: inverted cells by k-means, or random projections; exact scores decide in the end."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import score
from .search import scored, top_k

#: What rounding may take from a bound on a score.
SLACK = 1e-6


class InvertedCells:
    """Vectors by the k-means cell they lie in; a query scans the cells that can hold one of its
    k best by their spread, or the ``probes`` nearest ones.

    Stored partitioned by ``cell``, the cells that aren't probed aren't read.
    """

    def __init__(self, model: KMeansModel):
        self.centres = np.array(model.clusterCenters())
        self.model = model

    @classmethod
    def fit(cls, rows: DataFrame, cells: int = 16, sample: float = 1.0, seed: int = 3) -> InvertedCells:
        some = rows if sample >= 1 else rows.sample(sample, seed)
        return cls(KMeans(k=cells, seed=seed, maxIter=15).fit(some.select(array_to_vector("vector").alias("features"))))

    def assign(self, rows: DataFrame) -> DataFrame:
        out = self.model.transform(rows.withColumn("features", array_to_vector("vector")))
        return out.withColumnRenamed("prediction", "cell").drop("features")

    def spread(self, assigned: DataFrame) -> dict[int, tuple[int, float, float]]:
        """By cell that holds vectors: their number, the largest distance and the largest angle to its centre."""
        centres = assigned.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, _centre array<double>")
        far = [F.min(score(F.col("vector"), F.col("_centre"), m)) for m in ("EUCLIDEAN", "COSINE")]
        out = {}
        for r in assigned.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.count("*"), *far).collect():
            out[r[0]] = (r[1], np.inf if r[2] is None else float(np.sqrt(max(0.0, 1 / r[2] - 1))), np.pi if r[3] is None else float(np.arccos(np.clip(2 * r[3] - 1, -1, 1))))
        return out

    def reach(self, query: Sequence[float], spread: dict[int, tuple[int, float, float]], metric: str = "COSINE") -> dict[int, float]:
        """By cell, a score that none of its vectors exceeds: they lie within its spread, whatever their direction."""
        q, out = np.asarray(query, float), {}
        for cell, (_, radius, angle) in spread.items():
            c = self.centres[cell]
            if metric == "DOT_PRODUCT":
                top = (1 + q @ c + np.sqrt(q @ q) * radius) / 2
            elif metric == "EUCLIDEAN":
                top = 1 / (1 + max(0.0, np.sqrt(((q - c) ** 2).sum()) - radius) ** 2)
            else:
                size = np.sqrt((q @ q) * (c @ c))
                top = (1 + np.cos(max(0.0, np.arccos(np.clip(q @ c / size, -1, 1)) - angle))) / 2 if size > 0 else 1.0
            out[cell] = float(top) + SLACK
        return out

    def search(self, assigned: DataFrame, query: Sequence[float], k: int = 10, probes: int | None = None, metric: str = "COSINE") -> DataFrame:
        """The k best of the ``probes`` nearest cells; without a number, of all cells that can hold one of the k best."""
        if probes is None:
            spread = self.spread(assigned)
            reach = self.reach(query, spread, metric)
            first, held = [], 0
            for cell in sorted(reach, key=lambda x: (-reach[x], x)):
                if held < k:
                    first.append(cell)
                    held += spread[cell][0]
            got = [r[0] for r in top_k(scored(assigned.where(F.col("cell").isin(first)), query, metric), k).select("score").collect()]
            near = [cell for cell in reach if len(got) < k or reach[cell] >= min(got)]
        else:
            d = ((self.centres - np.asarray(query, float)) ** 2).sum(1)
            near = [int(x) for x in np.argsort(d, kind="stable")[:probes]]
        return top_k(scored(assigned.where(F.col("cell").isin(near)), query, metric), k)


def lsh_search(rows: DataFrame, query: Sequence[float], k: int = 10, rerank_k: int = 100, tables: int = 8, width: float = 0.6, metric: str = "COSINE", seed: int = 3) -> DataFrame:
    """The rerank_k rows that random projections find near, of these the k best by exact score."""
    from pyspark.ml.linalg import Vectors

    data = rows.withColumn("features", array_to_vector("vector"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(data)
    pool = model.approxNearestNeighbors(data, Vectors.dense([float(x) for x in query]), max(rerank_k, k))
    return top_k(scored(pool.drop("features", "hashes", "distCol"), query, metric), k)
