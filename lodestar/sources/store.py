"""The persistent collection: buckets, indexes, segments on Parquet, versioned manifests, deletes, retention.

Layout below the root, on any Hadoop file system::

    catalog/buckets/<bucket>.json            catalog/indexes/<bucket>/<index>.json
    data/<bucket>/<index>/segments/<id>/     Parquet: id, ordinal, vector, attributes (and promoted attr_<key>)
    data/<bucket>/<index>/tombstones/<n>/    Parquet: segment_id, ordinal; those that commit n added
    data/<bucket>/<index>/staged/<n>/        Parquet: id; deletes that no commit has applied yet
    data/<bucket>/<index>/manifests/<n>.json written last and never over another: a commit is seen whole or not at all
"""

from __future__ import annotations

import hmac
import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import METRICS
from ..operators import lookup, search
from ..operators.postings import CAP
from ..plans.filters import parse, to_column

NAME = re.compile(r"[a-z0-9][a-z0-9-]{0,126}[a-z0-9]|[a-z0-9]")
VECTOR_SCHEMA = "id string, vector array<float>, attributes map<string,string>"
MAX_PUT = MAX_DELETE = 10_000
DEFAULTS = {"m": 16, "beamWidth": 100, "neighborOverflow": 1.2, "alpha": 1.2, "addHierarchy": False, "pqSubspaces": None, "pqSubspaceClusters": None, "cacheBytes": 0}


class StoreError(Exception):
    def __init__(self, status: int, code: str, what: str = ""):
        super().__init__(f"{status} {code} {what}".strip())
        self.status, self.code = status, code


class EmptyCommit(StoreError):
    def __init__(self) -> None:
        super().__init__(409, "empty_commit")


class Files:
    """The few file operations that the catalog takes, by Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def read(self, p: str) -> dict:
        stream = self.fs.open(self._path(p))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, p: str, value: dict, over: bool = True) -> None:
        stream = self.fs.create(self._path(p), over)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()

    def write_once(self, p: str, value: dict) -> bool:
        """Write aside, then rename: readers see all of the file or none, and of two writers one is told that it lost."""
        aside = f"{p}.{uuid.uuid4().hex}.tmp"
        self.write(aside, value, over=False)
        done = not self.exists(p) and self.fs.rename(self._path(aside), self._path(p))
        if not done:
            self.delete(aside)
        return done

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(p))) if self.exists(p) else []

    def size(self, p: str) -> int:
        return self.fs.getContentSummary(self._path(p)).getLength()

    def delete(self, p: str) -> None:
        self.fs.delete(self._path(p), True)


def now() -> str:
    return datetime.now(UTC).isoformat()


def segment_id() -> str:
    """Names whose order is that of their making."""
    return f"{time.time_ns() // 1_000_000:012x}-{uuid.uuid4().hex[:20]}"


def build_params(given: dict[str, Any] | None) -> dict[str, Any]:
    """Given parameters over the defaults; unknown ones are dropped, values checked."""
    p = DEFAULTS | {k: v for k, v in (given or {}).items() if k in DEFAULTS}
    checks = {
        "m": p["m"] >= 1, "beamWidth": p["beamWidth"] >= 1, "neighborOverflow": p["neighborOverflow"] >= 1, "alpha": p["alpha"] > 0, "cacheBytes": p["cacheBytes"] >= 0,
        "pqSubspaces": p["pqSubspaces"] is None or p["pqSubspaces"] >= 1, "pqSubspaceClusters": p["pqSubspaceClusters"] is None or 2 <= p["pqSubspaceClusters"] <= 256,
    }
    for k, ok in checks.items():
        if not ok:
            raise StoreError(400, "bad_request", k)
    return p


def with_ordinals(rows: DataFrame) -> DataFrame:
    """ordinal 0..n-1 in partition order without one big sort: counts by partition give each its offset.

    rows must read the same both times, so they come from files or local data.
    """
    numbered = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).withColumn("_n", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = sorted((r["_part"], r["n"]) for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for part, n in sizes:
        starts[part] = total
        total += n
    if not starts:
        return rows.withColumn("ordinal", F.lit(0).cast("long"))
    at = F.broadcast(rows.sparkSession.createDataFrame([(int(k), int(v)) for k, v in starts.items()], "_part long, _start long"))
    return numbered.join(at, "_part").withColumn("ordinal", F.col("_start") + F.col("_n")).drop("_id", "_part", "_n", "_start")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.open: dict[str, Index] = {}

    def _bucket(self, b: str) -> str:
        return f"{self.root}/catalog/buckets/{b}.json"

    def _index(self, b: str, i: str) -> str:
        return f"{self.root}/catalog/indexes/{b}/{i}.json"

    def _row(self, path: str, code: str, any_state: bool = False) -> dict:
        row = self.files.read(path) if self.files.exists(path) else None
        if row is None or row["deleted_at"] and not any_state:
            raise StoreError(404, code)
        return row

    def _create(self, path: str, kind: str, row: dict) -> dict:
        for name in (row["id"],):
            if not NAME.fullmatch(name):
                raise StoreError(400, "bad_request", name)
        if not 1 <= len(row["display_name"]) <= 255:
            raise StoreError(400, "bad_request", "display name")
        if self.files.exists(path):
            raise StoreError(409, f"{kind}_in_retention" if self.files.read(path)["deleted_at"] else f"{kind}_already_exists")
        self.files.write(path, row, over=False)
        return row

    def create_bucket(self, bucket: str, display_name: str | None = None) -> dict:
        return self._create(self._bucket(bucket), "bucket", {"id": bucket, "display_name": bucket if display_name is None else display_name, "created_at": now(), "deleted_at": None})

    def create_index(self, bucket: str, index: str, dimension: int, metric: str, display_name: str | None = None, params: dict | None = None) -> dict:
        self._row(self._bucket(bucket), "bucket_not_found")
        if dimension < 1 or metric not in METRICS:
            raise StoreError(400, "bad_request")
        row = {"id": index, "bucket": bucket, "display_name": index if display_name is None else display_name, "dimension": dimension, "metric": metric, "params": build_params(params), "created_at": now(), "deleted_at": None}
        return self._create(self._index(bucket, index), "index", row)

    def _rows(self, folder: str) -> list[dict]:
        return [self.files.read(f"{folder}/{x}") for x in self.files.names(folder) if x.endswith(".json")]

    def buckets(self, limit: int = 5000) -> list[dict]:
        return sorted((r for r in self._rows(f"{self.root}/catalog/buckets") if not r["deleted_at"]), key=lambda r: (r["created_at"], r["id"]))[:limit]

    def indexes(self, bucket: str, limit: int = 5000) -> list[dict]:
        self._row(self._bucket(bucket), "bucket_not_found")
        return self._active_indexes(bucket)[:limit]

    def _active_indexes(self, bucket: str) -> list[dict]:
        return sorted((r for r in self._rows(f"{self.root}/catalog/indexes/{bucket}") if not r["deleted_at"]), key=lambda r: (r["created_at"], r["id"]))

    def index(self, bucket: str, index: str) -> Index:
        """An active index; data operations don't look at its bucket."""
        row = self._row(self._index(bucket, index), "index_not_found")
        key = f"{bucket}/{index}"
        if key not in self.open or self.open[key].row != row:
            self.open[key] = Index(self, row)
        return self.open[key]

    def delete_bucket(self, bucket: str) -> None:
        row = self._row(self._bucket(bucket), "bucket_not_found")
        if self._active_indexes(bucket):
            raise StoreError(409, "bucket_not_empty")
        self.files.write(self._bucket(bucket), row | {"deleted_at": now()})

    def delete_index(self, bucket: str, index: str) -> None:
        """Segments stay until retention takes them; the buffer and staged deletes go at once."""
        row = self._row(self._index(bucket, index), "index_not_found")
        self.index(bucket, index).clear()
        self.files.write(self._index(bucket, index), row | {"deleted_at": now()})
        self.open.pop(f"{bucket}/{index}", None)

    def restore_bucket(self, bucket: str) -> None:
        row = self._row(self._bucket(bucket), "bucket_not_found", True)
        if not row["deleted_at"]:
            raise StoreError(409, "bucket_already_active")
        self.files.write(self._bucket(bucket), row | {"deleted_at": None})

    def restore_index(self, bucket: str, index: str) -> None:
        """The bucket comes back with its index, not the other way round."""
        row = self._row(self._index(bucket, index), "index_not_found", True)
        if not row["deleted_at"]:
            raise StoreError(409, "index_already_active")
        up = self._row(self._bucket(bucket), "bucket_not_found", True)
        if up["deleted_at"]:
            self.files.write(self._bucket(bucket), up | {"deleted_at": None})
        self.files.write(self._index(bucket, index), row | {"deleted_at": None})

    def sweep(self, window: timedelta) -> dict[str, int]:
        """Remove what was deleted before the window: indexes with their data, then buckets without children."""
        before, done = (datetime.now(UTC) - window).isoformat(), {"indexes": 0, "buckets": 0, "failed": 0}
        for b in self.files.names(f"{self.root}/catalog/indexes"):
            for row in self._rows(f"{self.root}/catalog/indexes/{b}"):
                if row["deleted_at"] and row["deleted_at"] < before:
                    try:
                        self.files.delete(f"{self.root}/data/{b}/{row['id']}")
                        self.files.delete(self._index(b, row["id"]))
                        done["indexes"] += 1
                    except Exception:  # one failure doesn't keep the rest
                        done["failed"] += 1
        for row in self._rows(f"{self.root}/catalog/buckets"):
            if row["deleted_at"] and row["deleted_at"] < before and not self.files.names(f"{self.root}/catalog/indexes/{row['id']}"):
                try:
                    self.files.delete(self._bucket(row["id"]))
                    done["buckets"] += 1
                except Exception:
                    done["failed"] += 1
        return done


@dataclass
class Index:
    store: Store
    row: dict
    buffer: list[DataFrame] = field(default_factory=list)
    cached: dict[str, DataFrame] = field(default_factory=dict)
    sizes: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.spark, self.files = self.store.spark, self.store.files
        self.base = f"{self.store.root}/data/{self.row['bucket']}/{self.row['id']}"

    # Writing

    def put(self, vectors: DataFrame | list[tuple]) -> dict[str, int]:
        """Append to the buffer; nothing shows before the commit.  A list is held to the limits of one request."""
        if isinstance(vectors, list):
            if not 1 <= len(vectors) <= MAX_PUT:
                raise StoreError(400, "bad_request", "1..10000 vectors")
            for x, v, a in vectors:
                if not x or not x.strip() or len(x) > 512 or not v or any(y is None for y in (a or {}).values()):
                    raise StoreError(400, "bad_request", f"vector {x!r}")
                search.check_dimension(v, self.row["dimension"])
            vectors = self.spark.createDataFrame([(x, [float(y) for y in v], a or {}) for x, v, a in vectors], VECTOR_SCHEMA)
        rows = vectors.select(
            F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"),
            F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>")).alias("attributes"),
        )
        size, bad = rows.agg(F.count("*"), F.count_if(F.coalesce(F.size("vector") != self.row["dimension"], F.lit(True)) | F.coalesce(F.trim("id") == "", F.lit(True)))).head()
        if bad:
            raise search.DimensionMismatch(f"{bad} vectors aren't of {self.row['dimension']} dimensions or have no id")
        self.buffer.append(rows)
        self.sizes.append(size)
        return {"accepted": size, "buffer_size": self.pending()}

    def pending(self) -> int:
        """Vectors put since the last commit, by counters of the puts."""
        return sum(self.sizes)

    def delete(self, ids: list[str] | DataFrame) -> None:
        """Stage ids; they are hidden at once and everywhere, known or not."""
        if isinstance(ids, list):
            if not 1 <= len(ids) <= MAX_DELETE:
                raise StoreError(400, "bad_request", "1..10000 ids")
            ids = self.spark.createDataFrame([(x,) for x in ids], "id string")
        old = self.staged()
        new = ids.select("id").distinct() if old is None else search.without(ids.select("id").distinct(), old, ["id"])
        new.write.parquet(f"{self.base}/staged/{segment_id()}")

    def clear(self) -> None:
        self.buffer.clear()
        self.sizes.clear()
        self.files.delete(f"{self.base}/staged")

    def commit(self, promote: Sequence[str] = (), batch: int | None = None, fail: Callable[[str], None] = lambda phase: None) -> dict[str, Any]:
        """One new segment of the buffer; staged deletes are resolved in all segments, the new one too; manifest last.

        A commit that fails loses the buffer and keeps the staged deletes.  Keys in ``promote`` also become columns.
        """
        taken, self.buffer, self.sizes = self.buffer, [], []
        if not taken:
            raise EmptyCommit
        last = self.manifest() or {"version": 0, "segments": [], "tombstones": []}
        new = segment_id()
        path = f"{self.base}/segments/{new}"
        fail("build")
        # Ordinals follow the order of puts; unions keep it, partition after partition.
        rows = with_ordinals(reduce(DataFrame.unionByName, taken))
        cols = ["id", "ordinal", "vector", "attributes", *[F.col("attributes")[k].alias(f"attr_{k}") for k in promote]]
        rows.select(*cols).write.parquet(path)
        fail("publish")
        staged = [f"{self.base}/staged/{x}" for x in self.files.names(f"{self.base}/staged")]
        segments = [*last["segments"], {"id": new, "vector_count": self.spark.read.parquet(path).count(), "bytes": self.files.size(path), "promoted": list(promote)}]
        tombstones = list(last["tombstones"])
        if staged:
            ids = self.spark.read.schema("id string").parquet(*staged)
            gone = lookup.ordinals_of(self._read(segments, ["id", "ordinal"]), ids).select("segment_id", "ordinal")
            old = self.tombstones(last)
            gone = gone if old is None else search.without(gone, old, ["segment_id", "ordinal"])
            at = f"{self.base}/tombstones/{new}"
            gone.write.parquet(at)
            tombstones.append(new)
            fail("tombstones")
        fail("catalog")
        made = {"version": last["version"] + 1, "segments": segments, "tombstones": tombstones, "created_at": now(), "batch": last.get("batch") if batch is None else batch}
        if not self.files.write_once(f"{self.base}/manifests/{made['version']:012d}.json", made):
            raise StoreError(409, "commit_conflict", str(made["version"]))
        for x in staged:
            self.files.delete(x)
        return {"segment_id": new, "vector_count": segments[-1]["vector_count"], "bytes": segments[-1]["bytes"], "manifest_version": made["version"], "committed_at": made["created_at"]}

    # Reading

    def manifest(self, version: int | None = None) -> dict | None:
        """The latest manifest, or an older one: segments aren't changed, so old versions stay readable."""
        names = [x for x in self.files.names(f"{self.base}/manifests") if x.endswith(".json")]
        name = names[-1] if version is None and names else f"{version or 0:012d}.json"
        return self.files.read(f"{self.base}/manifests/{name}") if name in names else None

    def _read(self, segments: list[dict], columns: list[str] | None = None) -> DataFrame:
        schema = "id string, ordinal long, vector array<float>, attributes map<string,string>"
        promoted = sorted(set.intersection(*[set(s["promoted"]) for s in segments])) if segments else []
        schema += "".join(f", `attr_{k}` string" for k in promoted)
        if not segments:
            return self.spark.createDataFrame([], schema + ", segment_id string, manifest_pos int")
        paths = [f"{self.base}/segments/{s['id']}" for s in segments]
        rows = self.spark.read.schema(schema).parquet(*paths).withColumn("segment_id", F.regexp_extract(F.col("_metadata.file_path"), r"/segments/([^/]+)/", 1))
        order = F.broadcast(self.spark.createDataFrame([(s["id"], n) for n, s in enumerate(segments)], "segment_id string, manifest_pos int"))
        out = rows.join(order, "segment_id")
        return out.select(*columns, "segment_id", "manifest_pos") if columns else out

    def rows(self, version: int | None = None) -> DataFrame:
        """All vectors of the manifest's segments: one scan of just these paths."""
        m = self.manifest(version)
        held = self.cached.get(str(m["version"])) if m else None
        return held if held is not None else self._read(m["segments"] if m else [])

    def tombstones(self, manifest: dict | None = None) -> DataFrame | None:
        m = manifest or self.manifest()
        return self.spark.read.schema("segment_id string, ordinal long").parquet(*[f"{self.base}/tombstones/{x}" for x in m["tombstones"]]) if m and m["tombstones"] else None

    def staged(self) -> DataFrame | None:
        names = self.files.names(f"{self.base}/staged")
        return self.spark.read.schema("id string").parquet(*[f"{self.base}/staged/{x}" for x in names]) if names else None

    def query(self, vector: Sequence[float], k: int = 10, where: dict | None = None, threshold: float = 0.0, rerank_floor: float = 0.0, rerank_k: int | None = None) -> DataFrame:
        """id, segment_id, ordinal, score, attributes; no rows from an index without a manifest."""
        if not 1 <= k <= 1000 or rerank_k is not None and not 1 <= rerank_k <= 10_000 or threshold < 0 or rerank_floor < 0:
            raise StoreError(400, "bad_request")
        search.check_dimension(vector, self.row["dimension"])
        e, rows = parse(where), self.rows()
        if e is not None:
            have = set(rows.columns)
            rows_where = rows.where(to_column(e, lambda key: F.col(f"`attr_{key}`") if f"attr_{key}" in have else F.col("attributes")[key]))
        else:
            rows_where = rows
        hits = search.nearest(search.accepted(rows_where, None, self.tombstones(), self.staged()), vector, k, self.row["metric"], threshold, rerank_floor)
        return search.enrich(hits, rows)

    def get(self, wanted: str) -> dict[str, Any]:
        r = lookup.get(self.rows(), [wanted], self.tombstones(), self.staged()).head()
        return {"id": wanted, "found": r["found"], "attributes": r["attributes"] if r["found"] else None}

    def stats(self) -> dict[str, int]:
        m = self.manifest() or {"segments": []}
        return {"segment_count": len(m["segments"]), "vector_count": sum(s["vector_count"] for s in m["segments"]), "bytes": sum(s["bytes"] for s in m["segments"]), "pending": self.pending()}

    def strategy(self, where: dict | None, cap: int = CAP) -> dict[str, str]:
        """"posting" or "scan" by segment."""
        from ..operators.postings import indexed_keys
        from ..plans.filters import choose

        e = parse(where)
        known = {r["segment_id"]: set(r["keys"]) for r in indexed_keys(self.rows(), cap).collect()}
        return {s["id"]: choose(e, known.get(s["id"], set())) for s in (self.manifest() or {"segments": []})["segments"]}

    def cache(self, policy: str) -> None:
        """RESIDENT keeps the rows of the present manifest in memory, which queries read until the next commit; SMART and MINIMAL let Spark's own caching be."""
        for x in self.cached.values():
            x.unpersist()
        self.cached.clear()
        m = self.manifest()
        if policy == "RESIDENT" and m:
            self.cached[str(m["version"])] = self._read(m["segments"]).persist()


@dataclass(frozen=True)
class Principal:
    key_id: str
    bucket: str | None


class Keys:
    """API keys ``id.secret``; the hasher is given, as no memory-hard one is at hand everywhere."""

    def __init__(self, hasher: Callable[[str], str]):
        self.hasher, self.rows = hasher, {}

    def add(self, key_id: str, secret: str, bucket: str | None = None) -> None:
        self.rows[key_id] = {"hash": self.hasher(secret), "bucket": bucket, "last_used_at": None}

    def authenticate(self, header: str | None, bucket: str | None = None, admin: bool = False) -> Principal:
        key, dot, secret = (header or "").removeprefix("Bearer ").partition(".")
        row = self.rows.get(key) if key and dot and secret else None
        if row is None or not hmac.compare_digest(row["hash"], self.hasher(secret)):
            raise StoreError(401, "unauthorized")
        if admin and row["bucket"] is not None or bucket is not None and row["bucket"] not in (None, bucket):
            raise StoreError(403, "forbidden")
        row["last_used_at"] = now()
        return Principal(key, row["bucket"])
