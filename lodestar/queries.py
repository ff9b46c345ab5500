"""Registered queries over the given tables and the same in SQL.

``embeddings`` stands for a collection: four segments by ``vec_id % 4`` and a
fifth that puts every 17th id again; attributes from label and id, ``region``
missing for every fifth; every 11th vector of the first four segments is
deleted for good, every 13th id by a staged delete.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .functions.scoring import score
from .operators import ann, evaluate, lookup, postings, search
from .operators.search import accepted, enrich, scored, search_many, top_k, top_k_per_segment
from .plans import catalog
from .plans.filters import from_postings, parse, ratio_bucket

K = 10
#: Digits of a score in the results; where SQL orders what it selects, it orders by the score of so many digits.
DECIMALS = 6
TUNED = {"eq": {"category": "A"}, "in": {"category": {"$in": ["A", "B"]}}, "and": {"category": "A", "region": "us"}, "or": {"$or": [{"category": "A"}, {"region": "eu"}]},
         "not": {"$not": {"category": "A"}}, "not_missing": {"$not": {"region": "us"}}, "mixed": {"$not": {"$or": [{"category": "B"}, {"region": "eu"}]}, "label": {"$in": ["0", "2", "3", "5", "6", "9"]}}}
_SQL_WHERE = {
    "eq": "category IS NOT DISTINCT FROM 'A'", "in": "coalesce(category IN ('A', 'B'), false)", "and": "category IS NOT DISTINCT FROM 'A' AND region IS NOT DISTINCT FROM 'us'",
    "or": "category IS NOT DISTINCT FROM 'A' OR region IS NOT DISTINCT FROM 'eu'", "not": "NOT (category IS NOT DISTINCT FROM 'A')", "not_missing": "NOT (region IS NOT DISTINCT FROM 'us')",
    "mixed": "NOT (category IS NOT DISTINCT FROM 'B' OR region IS NOT DISTINCT FROM 'eu') AND coalesce(label IN ('0', '2', '3', '5', '6', '9'), false)",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def collection(spark: SparkSession, d: str, again: bool = True) -> DataFrame:
    src = table(spark, d, "embeddings")
    w = W.partitionBy("segment_id").orderBy("vec_id")
    region = F.when(F.col("vec_id") % 5 == 0, None).when(F.col("vec_id") % 2 == 0, "us").otherwise("eu")
    base = src.select(
        "vec_id", F.concat(F.lit("seg-"), F.col("vec_id") % 4).alias("segment_id"), (F.col("vec_id") % 4).cast("int").alias("manifest_pos"), F.col("embedding").alias("vector"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("label") % 3 + 1).cast("int")).alias("category"), region.alias("region"), F.col("label").cast("string").alias("label"),
    )
    put_again = src.where("vec_id % 17 = 0").select(
        "vec_id", F.lit("seg-4").alias("segment_id"), F.lit(4).alias("manifest_pos"), F.col("embedding").alias("vector"), F.lit("R").alias("category"), F.lit("us").alias("region"), F.col("label").cast("string").alias("label"))
    rows = base.unionByName(put_again) if again else base
    rows = rows.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long")).withColumn("id", F.concat(F.lit("v-"), "vec_id"))
    full = F.map_from_arrays(F.array(F.lit("category"), F.lit("label"), F.lit("uniq")), F.array("category", "label", F.concat(F.lit("u-"), "vec_id")))
    attributes = F.when(F.col("region").isNull(), full).otherwise(F.map_concat(full, F.create_map(F.lit("region"), F.col("region"))))
    return rows.select("vec_id", "id", "segment_id", "manifest_pos", "ordinal", "vector", attributes.alias("attributes"))


def persisted(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id % 11 = 0 and manifest_pos < 4").select("segment_id", "ordinal")


def staged(rows: DataFrame) -> DataFrame:
    return rows.where("vec_id % 13 = 0").select("id").distinct()


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    r = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").head()
    return [float(x) for x in r[0]] if r else []


BASE = """WITH base AS (
  SELECT vec_id, 'seg-' || (vec_id % 4) AS segment_id, CAST(vec_id % 4 AS INTEGER) AS manifest_pos, CAST(embedding AS DOUBLE[]) AS vector,
    CASE label % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS category,
    CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 2 = 0 THEN 'us' ELSE 'eu' END AS region, CAST(label AS VARCHAR) AS label FROM embeddings
  UNION ALL SELECT vec_id, 'seg-4', 4, CAST(embedding AS DOUBLE[]), 'R', 'us', CAST(label AS VARCHAR) FROM embeddings WHERE vec_id % 17 = 0
), v AS (
  SELECT *, 'v-' || vec_id AS id, row_number() OVER (PARTITION BY segment_id ORDER BY vec_id) - 1 AS ordinal FROM base
), q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id < 20), one AS (SELECT qv FROM q WHERE qid = 0),
dead AS (SELECT segment_id, ordinal FROM v WHERE vec_id % 11 = 0 AND manifest_pos < 4), held AS (SELECT DISTINCT id FROM v WHERE vec_id % 13 = 0),
pairs AS (SELECT segment_id, ordinal, id, 'category' AS key, category AS value FROM v UNION ALL SELECT segment_id, ordinal, id, 'label', label FROM v
  UNION ALL SELECT segment_id, ordinal, id, 'uniq', 'u-' || vec_id FROM v UNION ALL SELECT segment_id, ordinal, id, 'region', region FROM v WHERE region IS NOT NULL)"""
SCORE = {"COSINE": "(1 + list_cosine_similarity(vector, qv)) / 2", "EUCLIDEAN": "1 / (1 + list_distance(vector, qv) * list_distance(vector, qv))", "DOT_PRODUCT": "(1 + list_inner_product(vector, qv)) / 2"}
_ORDER = "ORDER BY score DESC, id, segment_id, ordinal"
_OUT = "id, segment_id, CAST(ordinal AS BIGINT) AS ordinal, round(score, 6) AS score"


def _out(df: DataFrame) -> DataFrame:
    return df.select("id", "segment_id", F.col("ordinal").cast("long").alias("ordinal"), F.round("score", 6).alias("score"))


def _knn(where: dict | None = None, metric: str = "COSINE", deletes: tuple[bool, bool] = (False, False), again: bool = True, **more) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = collection(spark, d, again)
        keep = accepted(rows, where, persisted(rows) if deletes[0] else None, staged(rows) if deletes[1] else None)
        return _out(search.nearest(keep, query_vector(spark, d), K, metric, decimals=DECIMALS, **more))

    return run


def _knn_sql(where: str = "true", metric: str = "COSINE", least: float = 0.0) -> str:
    return f"{BASE} SELECT {_OUT} FROM (SELECT *, {SCORE[metric]} AS score FROM v, one WHERE {where}) WHERE score >= {least} {_ORDER} LIMIT {K}"


_DEAD = "NOT EXISTS (SELECT 1 FROM dead WHERE dead.segment_id = v.segment_id AND dead.ordinal = v.ordinal)"
_HELD = "id NOT IN (SELECT id FROM held)"
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable, sql: str | None = None) -> None:
    Q[name] = run
    if sql is not None:
        SQL[name] = sql


def _def(sql: str | None = None):
    def put(f: Callable) -> Callable:
        _add(f.__name__, f, sql)
        return f

    return put


# Nearest neighbours

for _name, _metric in (("knn_cosine", "COSINE"), ("knn_euclidean", "EUCLIDEAN"), ("knn_dot", "DOT_PRODUCT")):
    _add(_name, _knn(metric=_metric), _knn_sql(metric=_metric))
for _name, _where in TUNED.items():
    _add(f"knn_filter_{_name}", _knn(_where), _knn_sql(_SQL_WHERE[_name]))
_add("knn_merge", _knn(deletes=(True, True)), _knn_sql(f"{_DEAD} AND {_HELD}"))
_add("knn_staged_delete", _knn(deletes=(False, True)), _knn_sql(_HELD))
_add("knn_persisted_delete", _knn(deletes=(True, False)), _knn_sql(_DEAD))
_add("knn_threshold", _knn(threshold=0.67), _knn_sql(least=0.67))
_add("knn_rerank_floor", _knn({"region": "us"}, rerank_floor=0.65), _knn_sql("region IS NOT DISTINCT FROM 'us'", least=0.65))


@_def(f"{BASE} SELECT {_OUT}, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY segment_id {_ORDER}) AS rank FROM (SELECT *, {SCORE['COSINE']} AS score FROM v, one)) WHERE rank <= {K}")
def knn_per_segment(spark: SparkSession, d: str) -> DataFrame:
    hits = top_k_per_segment(scored(collection(spark, d), query_vector(spark, d)), K)
    return hits.select("id", "segment_id", F.col("ordinal").cast("long").alias("ordinal"), F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@_def(f"{BASE}, hits AS (SELECT *, {SCORE['COSINE']} AS score FROM v, one {_ORDER} LIMIT {K}) SELECT {_OUT}, category, region FROM hits")
def knn_enrich(spark: SparkSession, d: str) -> DataFrame:
    rows = collection(spark, d)
    hits = enrich(search.nearest(rows, query_vector(spark, d), K), rows)
    return hits.select("id", "segment_id", "ordinal", F.round("score", 6).alias("score"), F.col("attributes")["category"].alias("category"), F.col("attributes")["region"].alias("region"))


@_def(f"{BASE}, pool AS (SELECT * FROM (SELECT *, list_inner_product(vector[1:16], qv[1:16]) AS proxy FROM v, one) ORDER BY proxy DESC, id, segment_id, ordinal LIMIT 50) SELECT {_OUT} FROM (SELECT *, {SCORE['COSINE']} AS score FROM pool) {_ORDER} LIMIT {K}")
def knn_two_phase(spark: SparkSession, d: str) -> DataFrame:
    q = query_vector(spark, d)
    return _out(search.two_phase(collection(spark, d), q, K, 50, score(F.slice("vector", 1, 16), q[:16], "DOT_PRODUCT"), decimals=DECIMALS))


@_def()
def knn_two_phase_whole(spark: SparkSession, d: str) -> DataFrame:
    """Two phases whose pool is as large as a bound on the scores needs it; knn_two_phase keeps the pool of its SQL."""
    return _out(search.two_phase_whole(collection(spark, d), query_vector(spark, d), K, 50, 16, decimals=DECIMALS))


@_def(f"{BASE} SELECT {_OUT} FROM (SELECT *, 0.5::DOUBLE AS score FROM v) WHERE false")
def knn_empty_index(spark: SparkSession, d: str) -> DataFrame:
    return _out(top_k(scored(collection(spark, d).where(F.lit(False)), query_vector(spark, d)), K))


def _many_sql(where: str) -> str:
    return (f"{BASE}, s AS (SELECT qid, id, segment_id, ordinal, round({SCORE['COSINE']}, 9) AS score FROM v, q WHERE {where}), r AS (SELECT *, row_number() OVER (PARTITION BY qid {_ORDER}) AS rank FROM s) "
            f"SELECT qid, CAST(rank AS INTEGER) AS rank, {_OUT} FROM r WHERE rank <= {K}")


def _many(spark: SparkSession, d: str, where: dict | None = None) -> DataFrame:
    queries = table(spark, d, "embeddings").where("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    got = search_many(accepted(collection(spark, d), where), queries, K)
    return got.select("qid", F.col("rank").cast("int").alias("rank"), "id", "segment_id", "ordinal", F.round("score", 6).alias("score"))


_add("knn_batch", _many, _many_sql("true"))
_add("knn_batch_filtered", partial(_many, where=TUNED["mixed"]), _many_sql(_SQL_WHERE["mixed"]))


# Filters

@_def(f"{BASE} SELECT count(*) AS n FROM v WHERE {_SQL_WHERE['mixed']}")
def filter_scan_count(spark: SparkSession, d: str) -> DataFrame:
    return accepted(collection(spark, d), TUNED["mixed"]).agg(F.count("*").alias("n"))


@_def(f"{BASE} SELECT count(*) AS n FROM v WHERE {_SQL_WHERE['mixed']}")
def filter_posting_count(spark: SparkSession, d: str) -> DataFrame:
    rows = collection(spark, d)
    return from_postings(parse(TUNED["mixed"]), postings.exploded(rows), rows).agg(F.count("*").alias("n"))


_RATIO = f"{BASE}, r AS (SELECT segment_id, count(*) AS size, count(*) FILTER (WHERE {_SQL_WHERE['and']} AND {_DEAD} AND {_HELD}) AS accepted FROM v GROUP BY segment_id)"


def _ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = collection(spark, d)
    return search.filtered_ratio(rows, TUNED["and"], persisted(rows), staged(rows))


@_def(f"{_RATIO} SELECT segment_id, size, accepted, round(accepted / size, 6) AS ratio FROM r")
def filtered_ratio_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return _ratio(spark, d).withColumn("ratio", F.round("ratio", 6))


@_def(f"{_RATIO} SELECT segment_id, CASE WHEN accepted / size < 0.25 THEN '0-25' WHEN accepted / size < 0.5 THEN '25-50' WHEN accepted / size < 0.75 THEN '50-75' ELSE '75-100' END AS bucket FROM r")
def filter_ratio_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _ratio(spark, d).select("segment_id", ratio_bucket(F.col("accepted"), F.col("size")).alias("bucket"))


# Deletes, lookup, statistics

@_def(f"{BASE} SELECT segment_id, CAST(ordinal AS BIGINT) AS ordinal, id FROM v WHERE id IN (SELECT id FROM held)")
def ordinals_of(spark: SparkSession, d: str) -> DataFrame:
    rows = collection(spark, d)
    return lookup.ordinals_of(rows, staged(rows)).select("segment_id", "ordinal", "id")


@_def(f"{BASE} SELECT segment_id, CAST(ordinal AS BIGINT) AS ordinal FROM dead UNION SELECT segment_id, CAST(ordinal AS BIGINT) FROM v WHERE id IN (SELECT id FROM held)")
def tombstone_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = collection(spark, d)
    return lookup.merge_tombstones(persisted(rows), lookup.ordinals_of(rows, staged(rows)))


@_def(f"{BASE} SELECT id FROM held UNION SELECT DISTINCT id FROM v WHERE vec_id % 3 = 0")
def stage_idempotent(spark: SparkSession, d: str) -> DataFrame:
    rows = collection(spark, d)
    return lookup.stage(staged(rows), rows.where("vec_id % 3 = 0").select("id"))


@_def(f"{BASE} SELECT id, segment_id, CAST(ordinal AS BIGINT) AS ordinal FROM v WHERE vec_id % 13 <> 0")
def delete_then_put_same_commit(spark: SparkSession, d: str) -> DataFrame:
    """What a commit leaves whose staged deletes also reach its own new segment."""
    rows = collection(spark, d)
    gone = lookup.ordinals_of(rows, staged(rows)).select("segment_id", "ordinal")
    return search.without(rows, gone, ["segment_id", "ordinal"]).select("id", "segment_id", "ordinal")


@_def(f"{BASE} SELECT id, segment_id, CAST(ordinal AS BIGINT) AS ordinal FROM v WHERE vec_id % 17 = 0 AND {_DEAD}")
def reput_after_commit(spark: SparkSession, d: str) -> DataFrame:
    """Vectors put again after a commit that deleted them show, in their new segment."""
    rows = collection(spark, d)
    return accepted(rows.where("vec_id % 17 = 0"), None, persisted(rows)).select("id", "segment_id", "ordinal")


_GET = """{base}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY manifest_pos, ordinal) AS n FROM v WHERE id IN ({ids})) WHERE n = 1),
ok AS (SELECT * FROM first v WHERE {dead} AND {held})
SELECT a.id, ok.id IS NOT NULL AS found, ok.category FROM (SELECT unnest([{ids}]) AS id) a LEFT JOIN ok ON ok.id = a.id"""


def _get(ids: list[str], dead: bool, held: bool) -> tuple[Callable, str]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = collection(spark, d)
        got = lookup.get(rows, ids, persisted(rows) if dead else None, staged(rows) if held else None)
        return got.select("id", "found", F.col("attributes")["category"].alias("category"))

    return run, _GET.format(base=BASE, ids=", ".join(f"'{x}'" for x in ids), dead=_DEAD if dead else "true", held=_HELD if held else "true")


_add("get_vector", *_get(["v-1", "v-2", "v-34", "v-999999999"], False, False))
_add("get_vector_tombstoned", *_get(["v-1", "v-11", "v-13", "v-26"], True, True))
_add("get_vector_reput", *_get(["v-17", "v-187", "v-374"], True, False))


def _segments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("segment_id").agg(F.count("*").alias("vector_count"), F.sum(F.size("vector") * 4).cast("long").alias("bytes"))


@_def(f"{BASE} SELECT count(DISTINCT segment_id) AS segment_count, count(*) AS vector_count, CAST(sum(len(vector) * 4) AS BIGINT) AS bytes, 7::BIGINT AS pending FROM v")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return lookup.stats(_segments(collection(spark, d)), 7)


_MANIFESTS = [("b/i", 1, '["seg-0"]'), ("b/i", 2, '["seg-0","seg-2","seg-1","seg-9"]'), ("b/j", 1, '["seg-3","seg-4"]')]


@_def(f"""{BASE}, s AS (SELECT segment_id, count(*) AS vector_count, CAST(sum(len(vector) * 4) AS BIGINT) AS bytes FROM v GROUP BY segment_id),
m(index_id, version, pos, segment_id) AS (VALUES ('b/i', 2, 0, 'seg-0'), ('b/i', 2, 1, 'seg-2'), ('b/i', 2, 2, 'seg-1'), ('b/i', 2, 3, 'seg-9'), ('b/j', 1, 0, 'seg-3'), ('b/j', 1, 1, 'seg-4'))
SELECT index_id, CAST(version AS INTEGER) AS version, CAST(pos AS INTEGER) AS pos, segment_id, vector_count, bytes FROM m JOIN s USING (segment_id)""")
def active_segments(spark: SparkSession, d: str) -> DataFrame:
    manifests = spark.createDataFrame(_MANIFESTS, "index_id string, version int, segment_ids string")
    return lookup.active_segments(manifests, _segments(collection(spark, d)))


@_def(f"{BASE} SELECT segment_id, count(*) AS vector_count, CAST(min(ordinal) AS BIGINT) AS first, CAST(max(ordinal) AS BIGINT) AS last FROM v WHERE manifest_pos IN (0, 4) GROUP BY segment_id")
def commit_two_segments(spark: SparkSession, d: str) -> DataFrame:
    """Two commits make two segments, each with ordinals 0..n-1."""
    rows = collection(spark, d).where("manifest_pos in (0, 4)")
    return rows.groupBy("segment_id").agg(F.count("*").alias("vector_count"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


@_def("SELECT CASE WHEN vec_id % 3 = 0 THEN 'b/i' ELSE 'b/j' END AS index_id, count(*) AS pending FROM embeddings GROUP BY 1")
def buffer_pending(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(F.when(F.col("vec_id") % 3 == 0, "b/i").otherwise("b/j").alias("index_id")).agg(F.count("*").alias("pending"))


@_def(f"{BASE} SELECT segment_id, count(*) AS staged FROM v WHERE id IN (SELECT id FROM held) GROUP BY segment_id")
def staged_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = collection(spark, d)
    return lookup.ordinals_of(rows, staged(rows)).groupBy("segment_id").agg(F.count("*").alias("staged"))


# Posting lists

_CAP = 50
_KEPT = f"""{BASE}, card AS (SELECT segment_id, key, count(DISTINCT value) AS "values" FROM pairs GROUP BY segment_id, key), kept AS (SELECT p.* FROM pairs p JOIN card USING (segment_id, key) WHERE card."values" <= {_CAP})"""


@_def(f"{_KEPT} SELECT segment_id, key, value, array_to_string(list_sort(list(ordinal)), ',') AS ordinals FROM kept GROUP BY segment_id, key, value")
def posting_lists(spark: SparkSession, d: str) -> DataFrame:
    return postings.lists(collection(spark, d), _CAP).select("segment_id", "key", "value", F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ",").alias("ordinals"))


@_def(f"{_KEPT} SELECT segment_id, key, value, count(*) AS n FROM kept GROUP BY segment_id, key, value")
def posting_lengths(spark: SparkSession, d: str) -> DataFrame:
    return postings.bitmaps(collection(spark, d), _CAP).groupBy("segment_id", "key", "value").agg(F.sum("n").alias("n"))


@_def(f'{_KEPT} SELECT segment_id, key, "values" FROM card')
def posting_key_cardinality(spark: SparkSession, d: str) -> DataFrame:
    return postings.key_cardinality(collection(spark, d))


@_def(f'{_KEPT} SELECT segment_id, key, "values" FROM card WHERE "values" > {_CAP}')
def posting_skipped_keys(spark: SparkSession, d: str) -> DataFrame:
    return postings.skipped_keys(collection(spark, d), _CAP)


# Catalog

_BUCKETS = [("b1", "2026-01-01", None), ("b2", "2026-01-02", None), ("b3", "2026-01-03", "2026-02-01"), ("b4", "2026-01-04", "2026-03-01"), ("b5", "2026-01-05", None), ("b6", "2026-01-06", "2026-02-10"), ("b7", "2026-01-08", "2026-02-11")]
_INDEXES = [("b1/x", "b1", "2026-01-02", None, '{"m":16,"addHierarchy":false}'), ("b1/y", "b1", "2026-01-03", "2026-02-02", '{"m":32}'), ("b2/x", "b2", "2026-01-04", "2026-03-03", '{"addHierarchy":true}'),
            ("b3/x", "b3", "2026-01-05", "2026-02-03", "{"), ("b6/x", "b6", "2026-01-06", "2026-03-04", '{"m":16}'), ("b3/y", "b3", "2026-01-07", None, '{"m":8,"other":1}')]
_BEFORE = "2026-02-15"


def _buckets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_BUCKETS, "bucket_id string, created_at string, deleted_at string")


def _indexes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_INDEXES, "index_id string, bucket_id string, created_at string, deleted_at string, engine_params string")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in rows)


_CATALOG = f"WITH b(bucket_id, created_at, deleted_at) AS (VALUES {_values(_BUCKETS)}), i(index_id, bucket_id, created_at, deleted_at, engine_params) AS (VALUES {_values(_INDEXES)})"


@_def(f"{_CATALOG} SELECT index_id, bucket_id FROM i WHERE deleted_at IS NULL AND bucket_id IN (SELECT bucket_id FROM b WHERE deleted_at IS NULL)")
def catalog_active_indexes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.active_indexes(_indexes(spark), _buckets(spark)).select("index_id", "bucket_id")


@_def(f"{_CATALOG} SELECT bucket_id FROM b WHERE deleted_at IS NULL AND bucket_id NOT IN (SELECT bucket_id FROM i WHERE deleted_at IS NULL)")
def deletable_buckets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.deletable_buckets(_buckets(spark), _indexes(spark)).select("bucket_id")


@_def(f"{_CATALOG} SELECT b.bucket_id, count(i.index_id) AS children FROM b LEFT JOIN i USING (bucket_id) GROUP BY b.bucket_id")
def bucket_child_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.child_counts(_buckets(spark), _indexes(spark))


@_def(f"{_CATALOG} SELECT index_id FROM i WHERE deleted_at < '{_BEFORE}'")
def retention_indexes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.expired(_indexes(spark), F.lit(_BEFORE)).select("index_id")


@_def(f"{_CATALOG} SELECT bucket_id FROM b WHERE deleted_at < '{_BEFORE}' AND bucket_id NOT IN (SELECT bucket_id FROM i WHERE deleted_at IS NULL OR deleted_at >= '{_BEFORE}')")
def retention_buckets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.expired_buckets(_buckets(spark), _indexes(spark), F.lit(_BEFORE)).select("bucket_id")


@_def(f"""{_CATALOG}, s AS (SELECT index_id, CASE WHEN NOT json_valid(engine_params) THEN 'unreadable' WHEN coalesce(CAST(json_extract(engine_params, '$.m') AS INTEGER), 16) <> 16
  OR coalesce(CAST(json_extract(engine_params, '$.addHierarchy') AS BOOLEAN), false) THEN 'drifted' END AS state FROM i) SELECT index_id, state FROM s WHERE state IS NOT NULL""")
def params_drift(spark: SparkSession, d: str) -> DataFrame:
    return catalog.params_drift(_indexes(spark))


# Text

_CHUNKS = r"""WITH w AS (SELECT 'doc-' || doc_id AS slug, string_split_regex(regexp_replace(text, '[ \t\n\x0B\f\r]+$', ''), '[ \t\n\x0B\f\r]+') AS w FROM documents),
n AS (SELECT slug, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 180) / 150.0) AS BIGINT)) + 1)) AS k FROM w WHERE len(list_filter(w, lambda x: x <> '')) > 0)"""


@_def(_CHUNKS + " SELECT slug || '-chunk-' || CASE WHEN k < 100 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS id, slug, CAST(k AS INTEGER) AS ordinal, trim(array_to_string(w[k * 150 + 1 : k * 150 + 180], ' ')) AS text FROM n")
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(table(spark, d, "documents"), F.concat(F.lit("doc-"), "doc_id"))


@_def(_CHUNKS + " SELECT slug, count(*) AS chunks FROM n GROUP BY slug")
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.chunks(table(spark, d, "documents"), F.concat(F.lit("doc-"), "doc_id")).groupBy("slug").agg(F.count("*").alias("chunks"))


@_def()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_to_text("html").alias("text"))


@_def()
def fnv1a64(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.fnv1a64("source").alias("hash"))


# Evaluation

_HITS = _many_sql("true").replace(f"SELECT qid, CAST(rank AS INTEGER) AS rank, {_OUT} FROM r", ", hits AS (SELECT r.qid, r.rank, r.id, CAST(e.label AS VARCHAR) AS expected, v.label AS got FROM r JOIN v USING (segment_id, ordinal) JOIN embeddings e ON e.vec_id = r.qid") + ")"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = collection(spark, d)
    hits = _many(spark, d).join(rows.select("segment_id", "ordinal", F.col("attributes")["label"].alias("got")), ["segment_id", "ordinal"])
    return hits.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("label").cast("string").alias("expected")), "qid")


@_def(_HITS + " SELECT count(*) AS queries, count(*) FILTER (WHERE expected = got) AS correct FROM hits WHERE rank = 1")
def recall_top1(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_top1(_judged(spark, d))


@_def(_HITS + " , n AS (SELECT qid, count(*) FILTER (WHERE expected = got) AS n FROM hits WHERE rank <= 5 GROUP BY qid) SELECT count(*) AS queries, count(*) FILTER (WHERE n > 2) AS correct FROM n")
def recall_majority(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_majority(_judged(spark, d), 5)


_FIRST = f", near AS (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid {_ORDER}) AS rank FROM s WHERE segment_id IN ('seg-0', 'seg-1', 'seg-2')) WHERE rank <= {K})"


@_def(_HITS + _FIRST + " , t AS (SELECT DISTINCT qid, id FROM hits) SELECT count(*) AS truth, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM near WHERE near.qid = t.qid AND near.id = t.id)) AS matched, round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM near WHERE near.qid = t.qid AND near.id = t.id)) / count(*), 6) AS recall FROM t")
def recall_at_10(spark: SparkSession, d: str) -> DataFrame:
    """Recall of a search that leaves out the last two segments."""
    queries = table(spark, d, "embeddings").where("vec_id < 20").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    rows = collection(spark, d)
    got = search_many(rows.where("segment_id in ('seg-0', 'seg-1', 'seg-2')"), queries, K)
    return evaluate.recall_at(search_many(rows, queries, K), got).select("truth", "matched", F.round("recall", 6).alias("recall"))


@_def("""WITH c AS (SELECT CASE WHEN vec_id % 50 = 7 THEN ' ' ELSE 'v-' || (vec_id - vec_id % 40 // 39) END AS id, CASE WHEN vec_id % 70 = 3 THEN '' ELSE 't' END AS text, 's' || label AS slug,
  CASE WHEN vec_id % 60 = 1 THEN 63 ELSE 64 END AS n FROM embeddings)
SELECT 'blank_id' AS rule, count(*) FILTER (WHERE trim(id) = '') AS violations FROM c UNION ALL SELECT 'blank_text', count(*) FILTER (WHERE text = '') FROM c UNION ALL SELECT 'blank_slug', 0 FROM c WHERE false
UNION ALL SELECT 'blank_slug', 0 UNION ALL SELECT 'wrong_dimension', count(*) FILTER (WHERE n <> 64) FROM c UNION ALL SELECT 'not_finite', 0
UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT id FROM c GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'unknown_slug', 1""")
def fixture_violations(spark: SparkSession, d: str) -> DataFrame:
    src = table(spark, d, "embeddings")
    n = F.col("vec_id")
    corpus = src.select(
        F.when(n % 50 == 7, " ").otherwise(F.concat(F.lit("v-"), n - F.floor((n % 40) / 39))).alias("id"), F.when(n % 70 == 3, "").otherwise("t").alias("text"), F.concat(F.lit("s"), "label").alias("slug"),
        F.when(n % 60 == 1, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"),
    )
    queries = spark.createDataFrame([("q-1", "s1"), ("q-2", "nowhere")], "id string, expected string")
    return evaluate.fixture_violations(corpus, queries, 64)


# Approximate search

@_def()
def ann_ivf(spark: SparkSession, d: str) -> DataFrame:
    rows = collection(spark, d)
    cells = ann.InvertedCells.fit(rows)
    return _out(cells.search(cells.assign(rows), query_vector(spark, d), K))


@_def()
def ann_lsh(spark: SparkSession, d: str) -> DataFrame:
    return _out(ann.lsh_search(collection(spark, d), query_vector(spark, d), K))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Top ten cosine neighbours of vector 0 with label 3."""
    return _knn({"label": "3"})(spark, d)
