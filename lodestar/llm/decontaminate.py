"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to ``k`` edits (a share of its length).  Cut
into k + 1 pieces, at least one piece occurs exactly; an Aho-Corasick
automaton finds all exact piece hits in one pass over a text, each hit fixes
where the item would lie, and Myers' bit-parallel distance verifies it.
Texts and items are compared as folded words with a space before the first
and after the last, so case, punctuation and line breaks don't count as
edits, and a short item matches whole words only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import blocks
from .common import beside, keep, lean, scratch, table, trim

ERROR_RATE = 0.06
#: Bytes of items whose automaton is broadcast at once; a larger benchmark is scanned in several parts.
PART_BYTES = 8_000_000


def normal(texts: pa.Array) -> Iterator[bytes]:
    """Folded words with single spaces, as UTF-8."""
    for block in blocks(texts):
        data = np.where(block.word_mask(), block.folded, np.uint8(32)).tobytes()
        for lo, hi in zip(block.offsets[:-1], block.offsets[1:]):
            yield b" ".join(data[lo:hi].split())


def pieces(size: int, k: int) -> list[tuple[int, int]]:
    """k + 1 spans of nearly equal length."""
    cuts = [size * i // (k + 1) for i in range(k + 2)]
    return list(zip(cuts[:-1], cuts[1:]))


def budget(size: int, rate: float) -> int:
    return int(size * rate)


class Pattern:
    def __init__(self, item_id: int, words: str, rate: float):
        self.item_id, self.text, self.k = item_id, f" {words} ", budget(len(words), rate)
        text = self.text
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Least edits of the pattern against any part of text, and the end of that part: Myers' bit-vectors."""
        m = len(self.text)
        full, high = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best, end = full, 0, m, m, 0
        masks = self.masks
        for j, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph = (ph << 1) & full
            pv = ((mh << 1) & full) | (full & ~(xv | ph))
            mv = ph & xv
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    """The items' pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.patterns = []
        places: dict[str, list[tuple[int, int]]] = {}
        for (item_id, _), text in zip(items, normal(pa.array([t for _, t in items], type=pa.string()))):
            if not text:
                continue
            at = len(self.patterns)
            p = Pattern(item_id, text.decode("latin-1"), rate)
            self.patterns.append(p)
            for lo, hi in pieces(len(p.text), p.k):
                places.setdefault(p.text[lo:hi], []).append((at, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def match(self, raw: bytes) -> list[tuple[int, int, int, int]]:
        """item, first word, edits and error budget of every occurrence, by item and place; overlapping ones once."""
        if self.empty or not raw:
            return []
        text = f" {raw.decode('latin-1')} "
        starts: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for at, lo in where:
                starts.setdefault(at, []).append(end - size + 1 - lo)
        out = []
        for at, diagonals in starts.items():
            p = self.patterns[at]
            diagonals.sort()
            reach = 2 * p.k + 1
            i = 0
            while i < len(diagonals):
                j = i
                while j + 1 < len(diagonals) and diagonals[j + 1] - diagonals[j] <= reach and diagonals[j + 1] - diagonals[i] <= len(p.text) // 2:
                    j += 1
                lo = max(0, diagonals[i] - p.k)
                edits, end = p.best(text[lo : diagonals[j] + len(p.text) + p.k])
                if edits <= p.k:
                    start = max(0, lo + end - len(p.text))
                    out.append((p.item_id, max(0, text.count(" ", 0, start + 1) - 1), edits, p.k))
                i = j + 1
        out.sort(key=lambda x: (x[0], x[2], x[1]))
        kept: list[tuple[int, int, int, int]] = []
        for x in out:
            if not any(y[0] == x[0] and abs(y[1] - x[1]) <= 4 for y in kept):
                kept.append(x)
        return sorted(kept)


def _parts(benchmark: DataFrame, part_bytes: int) -> list[list[tuple[int, str]]]:
    """The items in parts that can be broadcast each."""
    parts, used = [[]], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        if used + len(text) > part_bytes and parts[-1]:
            parts.append([])
            used = 0
        parts[-1].append((item_id, text))
        used += len(text)
    return parts


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every occurrence of an item in a document: doc_id, item_id, first word, edits, error budget.

    Texts are searched whole.  Null, empty or wordless texts and items match nothing; an item so short that the
    budget is 0 must occur as it is.  Repeated documents are reported each, repeated items once an item_id; a document
    without doc_id is reported with a null.  Of overlapping matches of an item that of the fewest edits, then the
    first, is reported.  Other columns of docs aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")

    def over(items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def find(batches):
            matcher = Matcher(shared.value, rate)
            for b in batches:
                at, found = [], []
                for i, raw in enumerate(normal(b.column(1))):
                    for hit in matcher.match(raw):
                        at.append(i)
                        found.append(hit)
                cols = list(zip(*found)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, type=pa.int64())), *[pa.array(c, type=pa.int64()) for c in cols]], names=["doc_id", "item_id", "word_start", "edits", "budget"]
                )

        return rows.mapInArrow(find, "doc_id long, item_id long, word_start long, edits long, budget long")

    return reduce(DataFrame.unionByName, [over(x) for x in _parts(benchmark, part_bytes)])


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents in which no item occurs, with all their columns; null and empty texts stay, rows that repeat share a decision."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.where("text is not null").select(text.alias("text"), F.xxhash64(text).alias("__lodestar_hash"), F.octet_length(text).alias("__lodestar_size"))

    def over(items: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def find(batches):
            matcher = Matcher(shared.value, rate)
            for b in batches:
                at = pa.array([i for i, raw in enumerate(normal(b.column(0))) if matcher.match(raw)], type=pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at)], names=["__lodestar_hash", "__lodestar_size"])
            trim()

        return rows.mapInArrow(find, "__lodestar_hash long, __lodestar_size int")

    with scratch(spark), lean(spark):
        leaks = keep(reduce(DataFrame.unionByName, [over(x) for x in _parts(benchmark, part_bytes)]).distinct())
    same = (F.xxhash64(text) == F.col("__lodestar_hash")) & (F.octet_length(text) == F.col("__lodestar_size"))
    return docs.join(beside(leaks), same, "left_anti").select(docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents; rows as find_leaks says."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item occurs, with all their columns; nulls, empties and repeats as clean_documents says."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))
