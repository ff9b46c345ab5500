"""Best-two-fit packing of documents into training sequences.

Documents are measured in words; a document longer than a bin is cut into
whole bins and a remainder.  Remainders are dealt to shards by hash and each
shard is packed on its own: a bin is filled greedily, always with the
longest unpacked piece that fits; then, if room is left, its smallest piece
is taken out and two unpacked pieces go into the larger gap if they fill it
more tightly.  Only ids and lengths are shuffled, never texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPACITY = 2048
#: Pieces a shard holds on average; the number of shards follows the number of documents.
SHARD_PIECES = 20_000


class Pool:
    """Unpacked pieces by length, with the lengths at hand as bits of one integer and their mirror image."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        order = np.argsort(lengths, kind="stable")
        cuts = np.searchsorted(lengths[order], np.arange(capacity + 2))
        self.of = [order[cuts[n] : cuts[n + 1]][::-1].tolist() for n in range(capacity + 1)]
        self.bits = self.mirror = 0
        for n in range(1, capacity + 1):
            if self.of[n]:
                self._show(n)

    def _show(self, n: int) -> None:
        self.bits |= 1 << n
        self.mirror |= 1 << (self.capacity - n)

    def take(self, n: int) -> int:
        own = self.of[n]
        out = own.pop()
        if not own:
            self.bits ^= 1 << n
            self.mirror ^= 1 << (self.capacity - n)
        return out

    def give(self, n: int, piece: int) -> None:
        if not self.of[n]:
            self._show(n)
        self.of[n].append(piece)

    def longest(self, room: int) -> int:
        """The longest length at hand that fits, 0 if none does."""
        return (self.bits & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 and self.bits & ((1 << (room + 1)) - 1) else 0

    def two(self, least: int, room: int) -> tuple[int, int] | None:
        """Two lengths at hand with the largest sum in least+1..room; among equal sums the most uneven."""
        for total in range(room, max(least, 1), -1):
            both = self.bits & (self.mirror >> (self.capacity - total)) & ((1 << (total // 2 + 1)) - 1)
            while both:
                low = (both & -both).bit_length() - 1
                if low * 2 != total or len(self.of[low]) > 1:
                    return low, total - low
                both &= both - 1
        return None


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in the bin and start within the bin of each piece; lengths are 1..capacity."""
    lengths = np.asarray(lengths, dtype=np.int64)
    pool = Pool(lengths, capacity)
    bin_of, place, start = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
    no = 0
    while pool.bits:
        room, own = capacity, []
        while n := pool.longest(room):
            own.append((n, pool.take(n)))
            room -= n
        if room and own:
            n, piece = own[-1]  # greedy filling takes pieces from long to short
            if pair := pool.two(n, room + n):
                own.pop()
                own += [(x, pool.take(x)) for x in sorted(pair, reverse=True)]
                pool.give(n, piece)
        at = 0
        for k, (n, piece) in enumerate(own):
            bin_of[piece], place[piece], start[piece] = no, k, at
            at += n
        no += 1
    return bin_of, place, start


def words(text: Column) -> Column:
    """Number of runs of anything but spaces, tabs and line ends."""
    return F.size(F.filter(F.split(text, r"[ \t\r\n]+"), lambda x: x != ""))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, length: Column | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, first word, words, shard, bin (numbered within the shard), place and start in the bin.

    A piece of a whole bin has a bin of its own.  Of pieces of one length the least doc_id, then piece, goes first.
    A document without words (null, empty, blank) takes no room and isn't in the result; repeated rows are
    packed each; a null doc_id is packed as null.  ``length`` measures a row, by default in words.  Other columns
    of docs aren't read.
    """
    spark = docs.sparkSession
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (length if length is not None else words(F.col("text").cast("string"))).cast("long").alias("n")).where("n > 0")
    shards = max(1, -(-docs.select("doc_id").count() // shard_pieces))
    pieces = measured.select(
        "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece")
    ).select("doc_id", "piece", (F.col("piece") * capacity).alias("first_word"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("words"))
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard")
    part = pieces.select("doc_id", "piece", "first_word", "words", shard)

    def pack_shard(t: pa.Table) -> pa.Table:
        t = t.sort_by([("words", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bin_of, place, start = pack(t["words"].to_numpy(), capacity)
        for name, x in (("bin", bin_of), ("place", place), ("start", start)):
            t = t.append_column(name, pa.array(x))
        return t

    schema = "doc_id long, piece long, first_word long, words long, shard long, bin long, place long, start long"
    return part.groupBy("shard").applyInArrow(pack_shard, schema)


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing plan of all documents; rows as pack_documents says."""
    return pack_documents(table(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan of all documents that came so far: rows, nulls, empties, ties and repeats as pack_documents says."""
    return pack_documents(docs)
