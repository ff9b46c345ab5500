"""Searches as they are registered against the exact k best."""

from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import queries
from lodestar.functions.scoring import METRICS, scores
from lodestar.operators import ann
from lodestar.operators.search import scored, top_k


def ids(df):
    return [(r["id"], r["segment_id"]) for r in df.collect()]


def test_ann_ivf_registered(spark, monkeypatch):
    """The registered query, for vectors besides the first one; its cells are fitted once."""
    d, own = "/root/testdata/sf0.01", queries.query_vector
    rows = queries.collection(spark, d).cache()
    monkeypatch.setattr(queries, "collection", lambda *_: rows)
    monkeypatch.setattr(ann.InvertedCells, "fit", lru_cache(ann.InvertedCells.fit))
    for vec_id in (3, 77, 401):
        v = own(spark, d, vec_id)
        monkeypatch.setattr(queries, "query_vector", lambda *_: v)
        want = ids(top_k(scored(rows, v), 10))
        assert len(want) == 10 and len(set(want) & set(ids(queries.Q["ann_ivf"](spark, d)))) >= 9


@pytest.mark.parametrize("metric", METRICS)
def test_no_cell_is_missed(spark, sf_dir, metric):
    """The cells within reach hold all neighbours of every vector; some cells are left out where vectors form clumps."""
    rng = np.random.default_rng(2)
    clumps = [(f"c-{i}", "seg-0", i, (20.0 * np.eye(64)[i % 9] + rng.normal(size=64)).tolist()) for i in range(200)]
    for rows, clumped in ((queries.collection(spark, sf_dir), False), (spark.createDataFrame(clumps, "id string, segment_id string, ordinal long, vector array<double>"), True)):
        cells = ann.InvertedCells.fit(rows.cache())
        assigned = cells.assign(rows).select("cell", "vector").cache()
        got = assigned.collect()
        cell, v = np.array([r["cell"] for r in got]), np.array([r["vector"] for r in got])
        spread = cells.spread(assigned)
        s, left = scores(v, v, metric), 0
        for j in range(len(v)):
            least = np.sort(s[:, j])[-10]
            near = [c for c, top in cells.reach(v[j], spread, metric).items() if top >= least]
            assert set(cell[s[:, j] >= least]) <= set(near)
            left += len(spread) - len(near)
        assert left > 0 or not clumped


def test_ann_lsh_registered(spark):
    rows = queries.collection(spark, "/root/testdata/sf0.01").cache()
    hit = 0
    for q in (0, 3, 77, 401):
        v = rows.where(F.col("vec_id") == q).head()["vector"]
        hit += len(set(ids(top_k(scored(rows, v), 10))) & set(ids(ann.lsh_search(rows, v, 10))))
    assert hit >= 36


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_two_phases_lose_nothing(spark, sf):
    d = f"/root/testdata/{sf}"
    assert ids(queries.Q["knn_two_phase_whole"](spark, d)) == ids(queries.Q["knn_cosine"](spark, d))
