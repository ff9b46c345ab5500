"""Index rows on their way to the rows of equal key, and the groups that equal keys make.

A join on hashes moves many rows of a few numbers each.  They travel packed:
every map task sorts its rows into buckets of the key and hands Spark one
binary value a bucket, Spark shuffles buckets, and the receiving task sorts
the unpacked rows.  ``components`` finds the groups that pairs make.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small

#: Buckets a receiving task gets on average.
FINE = 4
#: Bytes of packed rows that are handed to Spark at a time.
PARCEL_BYTES = 1 << 20
#: Pairs up to which one task finds the components; beyond, rounds of joins do.
ONE_TASK_PAIRS = 3_000_000
#: Rows of a block of a large key; pairs of blocks are worked off apart.
CELL = 4096


def bucket_count(spark: SparkSession, docs: DataFrame) -> int:
    """Receiving tasks: as many as the input has partitions, and no fewer than Spark's own setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def pack(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """rows has a uint64 field ``key``; one output row a bucket that occurs."""
    to = (rows["key"] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    at = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(to))
    return pa.RecordBatch.from_arrays([pa.array(to[at], type=pa.int32()), pa.array([rows[a:z].tobytes() for a, z in zip(at, ends)], type=pa.binary())], names=["bucket", "packed"])


def parcels(rows: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """pack(rows, buckets) in batches of PARCEL_BYTES, exceeded by less than one value."""
    whole = pack(rows, buckets)
    part = (np.cumsum(pc.binary_length(whole.column(1)).to_numpy(), dtype=np.int64) - 1) // PARCEL_BYTES
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for a, z in zip(at, np.append(at[1:], len(part))):
        yield whole.slice(a, z - a)


def send(packed: DataFrame, tasks: int) -> DataFrame:
    return packed.repartition(tasks, "bucket")


def unpack(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    """All rows of this task whose key occurs at least twice, sorted by key and id."""
    parts = [np.frombuffer(x.as_buffer(), dtype=kind) for b in batches for x in b.column(1)]
    rows = np.concatenate(parts) if parts else np.zeros(0, kind)
    del parts
    order = np.argsort(rows["key"])
    key = rows["key"][order]
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = key[1:] == key[:-1]
    rows = rows[order[same[1:] | same[:-1]]]
    return rows[np.lexsort((rows["id"], rows["key"]))]


def groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of keys that two ids or more have, starts of the groups, and their sizes; rows are unique by key and id."""
    key = rows["key"]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(key)))
    rows = rows[np.repeat(size > 1, size)]
    size = size[size > 1]
    return rows, np.cumsum(size) - size, size


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def spread_pairs(first: np.ndarray, last: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) with first[i] <= j < last[i], about ``most`` at a time."""
    count = np.maximum(last - first, 0)
    total = np.concatenate(([0], np.cumsum(count)))
    i = 0
    while i < len(count):
        z = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
        own = np.repeat(np.arange(i, z), count[i:z])
        if len(own):
            yield own, np.arange(len(own)) - np.repeat(total[i:z] - total[i], count[i:z]) + first[own]
        i = z


def cells(rows: DataFrame, columns: list[str], cell: int = CELL) -> DataFrame:
    """The rows of keys with more than one root, by cells in which all pairs of a key meet: key, x, y, own and the columns.

    A key of n rows has blocks of about ``cell`` rows; a row goes to the cells (x, y) that its block ``own`` is a side
    of.  Pairs of one block meet in (x, x).  So no task needs to hold a key's rows at once.  All columns are longs.
    """
    mixed = rows.groupBy("key").agg(F.count("*").alias("_n"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("key", F.ceil(F.col("_n") / cell).alias("_blocks"))
    own = rows.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("id"), "_blocks")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    out = own.select("key", F.least("own", "_other").alias("x"), F.greatest("own", "_other").alias("y"), "own", *[F.col(c).cast("long").alias(c) for c in columns])
    return out.repartition("key", "x", "y")


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    a = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int64)
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):  # hook the larger root to the smaller, then halve the paths
        x, y = root[a], root[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["id", "root"])


def components(pairs: DataFrame, one_task: int = ONE_TASK_PAIRS) -> DataFrame:
    """id and the least id connected to it, for every id of the pairs (a, b); a table read back from disk.

    Few pairs go to one task.  More are worked off in rounds: every id hooks to the least id around it and
    its neighbours follow, until each is a neighbour of its component's least id.
    """
    pairs = pairs.select("a", "b").where("a <> b")
    if small(pairs, one_task):
        return cut(pairs.repartition(1).mapInArrow(_union, "id long, root long"))
    edges = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Larger neighbours of an id hook to its least; then each id and its smaller neighbours hook to the least of these.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        new = cut(down.join(low, "a").select(F.col("b").alias("x"), "m", "a").select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        if not new.exceptAll(edges).limit(1).count() and not edges.exceptAll(new).limit(1).count():
            roots = new.select(F.col("a").alias("id"), F.col("b").alias("root"))
            return cut(roots.union(roots.select("root", "root").distinct()))
        edges = new
