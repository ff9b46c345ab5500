import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.scoring import METRICS, score, scores
from lodestar.operators import ann, evaluate
from lodestar.operators.search import scored, search_many, top_k
from lodestar.queries import collection
from lodestar.sources import jsonl


@pytest.mark.parametrize("metric", METRICS)
def test_scores_agree(spark, metric):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(20, 130)), rng.normal(size=130)
    want = scores(v, q[None], metric)[:, 0]
    df = spark.createDataFrame([(i, x.tolist(), q.tolist()) for i, x in enumerate(v)], "i int, v array<double>, q array<double>")
    for other, n in ((q.tolist(), 130), (F.col("q"), 130), (q[:8].tolist(), 8)):
        got = [r[0] for r in df.orderBy("i").select(score(F.slice("v", 1, n), other, metric)).collect()]
        assert np.allclose(got, want if n == 130 else scores(v[:, :8], q[None, :8], metric)[:, 0])


def test_chunks(spark):
    docs = spark.createDataFrame([("a", " ".join(map(str, range(180)))), ("b", " ".join(map(str, range(181)))), ("c", "  \n"), ("d", ""), ("e", None), ("f", " x  y \n"), ("g", " ".join(map(str, range(480))))], "slug string, text string")
    got = {}
    for r in T.chunks(docs, F.col("slug")).orderBy("id").collect():
        got.setdefault(r["slug"], []).append((r["id"], r["ordinal"], r["text"]))
    assert {k: len(v) for k, v in got.items()} == {"a": 1, "b": 2, "f": 1, "g": 3}
    assert got["f"] == [("f-chunk-000", 0, "x y")] and got["b"][1][2].split()[0] == "150" and got["g"][2][2].split()[-1] == "479"
    with pytest.raises(ValueError):
        T.chunks(docs, F.col("slug"), target=10, overlap=10)


def test_html_and_hash(spark):
    html = "<body><nav><li>menu</li></nav><p>one <b>two</b><script>x='</p>'</script></p><table><p>no</p></table><h2>Kept</h2><ul><li>item</li></ul><h2>See also</h2><p>late</p></body>"
    assert T.plain(html) == "menu\n\none two\n\nKept\n\nitem" and T.plain(None) is None and T.plain("") == ""
    got = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "s string").select(T.fnv1a64("s")).collect()
    assert [None if r[0] is None else r[0] & (1 << 64) - 1 for r in got] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8, None]


def test_many_equals_one_by_one(spark, sf_dir):
    rows = collection(spark, sf_dir).cache()
    queries = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    many = search_many(rows, queries, 7).collect()
    for q in queries.collect():
        want = {(r["id"], r["segment_id"]) for r in top_k(scored(rows, q["vector"]), 7).collect()}
        assert {(r["id"], r["segment_id"]) for r in many if r["qid"] == q["qid"]} == want
    assert search_many(rows, queries.limit(0), 7).count() == 0 and search_many(rows.limit(0), queries, 7).count() == 0


def test_ann_recall(spark, sf_dir):
    rows = collection(spark, sf_dir, again=False).cache()
    cells = ann.InvertedCells.fit(rows, 8)
    assigned = cells.assign(rows).cache()
    hit = near = 0
    for q in range(6):
        v = rows.where(F.col("vec_id") == q).head()["vector"]
        want = {r["id"] for r in top_k(scored(rows, v), 10).collect()}
        hit += len(want & {r["id"] for r in cells.search(assigned, v, 10, 5).collect()})
        near += len(want & {r["id"] for r in ann.lsh_search(rows, v, 10, 200).collect()})
    assert hit >= 51 and near >= 51


def test_recall_and_fixtures(spark, tmp_path):
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "qid long, id string")
    assert evaluate.recall_at(truth, truth.limit(0)).head()["recall"] == 0
    assert evaluate.recall_at(truth.limit(0), truth).head()["recall"] is None
    corpus = spark.createDataFrame([("a", "s", 0, "t", [1.0]), ("a", "", 1, None, [float("nan")])], jsonl.CORPUS)
    jsonl.write(corpus, f"{tmp_path}/c")
    jsonl.validate(spark, f"{tmp_path}/c")
    assert jsonl.read(spark, f"{tmp_path}/c").count() == 2
    queries = spark.createDataFrame([("q", "s")], "id string, expected string")
    got = {r["rule"]: r["violations"] for r in evaluate.fixture_violations(corpus.withColumnRenamed("articleSlug", "slug"), queries, 1).collect()}
    assert got == {"blank_id": 0, "blank_text": 1, "blank_slug": 1, "wrong_dimension": 0, "not_finite": 1, "repeated_id": 1, "unknown_slug": 0}
    (tmp_path / "bad.jsonl").write_text('{"id":"a"}\n\n{"id":\n')
    with pytest.raises(jsonl.BrokenLine, match="bad.jsonl"):
        jsonl.validate(spark, f"{tmp_path}/bad.jsonl")
