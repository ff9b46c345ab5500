"""Line dedup by a segment-partition edit join.

Lines within ``budget`` edits (of UTF-8 bytes) of each other are one line
written twice: one edit for every ``EDIT_BYTES`` bytes of the shorter one,
``EDITS`` at most; shorter lines must be equal.  A line is cut into budget + 1
segments; a line within that many edits of it holds at least one of them, at
a place that the lengths of both lines limit.  So every line offers its
segments under (length, segment, bytes), probes for those of lines as long or
up to EDITS shorter at the few places where they can stand, and what meets is
verified by edit distance in bit-parallel bands, many pairs side by side.

Of a segment that more than ``ALL_PAIRS`` lines meet in, as short segments do
by chance in a large corpus, all pairs are still looked at where their bytes
rule most of them out.  Where they don't (lines that differ in a number, say),
neighbours by the rest of the line are verified first.  Where
that doesn't connect them all, the rest is cut into segments in its turn, and
lines that aren't connected yet meet at those, until few meet at one.

Equal lines are one line from the start, whatever their length.  Groups are
what close pairs connect; a group's first occurrence, by doc_id and line
number, stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .blocks import Block, block_of, blocks, mix, span_hash
from .common import beside, cut, keep, lean, scratch, semi, small, table, tidy, trim
from .runs import FINE, bucket_count, cells, components, groups, parcels, send, spread_pairs, unique_pairs, unpack

EDITS = 2
#: Bytes of a line for each edit that it may differ in.
EDIT_BYTES = 10
#: Lines of one segment up to which all pairs are verified that their bytes allow; how often the rest of more is cut again.
ALL_PAIRS, DEPTH = 256, 6
#: Lines of one segment up to which it is tried whether their bytes allow few pairs; pairs looked at in one step.
TRIED, STEP = 8192, 300_000
#: Pairs that are verified side by side, and bytes that these have at most as all are padded to the longest.
SIDE_BY_SIDE, PADDED = 4096, 4 << 20
#: Lines up to which their documents are broadcast to get their texts, and bits of the filter that does so for more.
FEW_TEXTS, FILTER_BITS = 200_000, 27
ROW = np.dtype([("key", "<u8"), ("id", "<i8"), ("bag", "<u4"), ("role", "u1")])
OFFERS, PROBES = 1, 2

_BIN = np.zeros(256, dtype=np.int64)
for _k, _c in enumerate(b" etaoinshrdlucmfwypvbgkjqxz"):
    _BIN[_c] = _k % 8
for _c in [*range(0, 32), *range(33, 97), *range(123, 256)]:
    _BIN[_c] = _c % 8


def lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends without blanks around, text, and line number of all lines that aren't blank."""
    data = block.data
    starts, ends, bounds = block.runs(data != 10)
    text = np.repeat(np.arange(len(block)), np.diff(bounds))
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    number = breaks[starts] - breaks[block.offsets[:-1]][text]
    solid = np.flatnonzero((data != 32) & (data != 9) & (data != 13) & (data != 10))
    a, z = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = z > a
    a, z = a[full], z[full]
    return (solid[a], solid[z - 1] + 1, text[full], number[full]) if len(a) else (a, z, text[full], number[full])


def hashed_lines(block: Block) -> tuple[np.ndarray, ...]:
    """lines() and a hash of each."""
    starts, ends, text, number = lines(block)
    return starts, ends, text, number, span_hash(block.prefix_hash(block.data), starts, ends).view(np.int64)


def budget(size: np.ndarray, k: int = EDITS) -> np.ndarray:
    """Edits that a line may differ in from one as long or longer."""
    return np.minimum(k, size // EDIT_BYTES)


@lru_cache(maxsize=8)
def places(k: int) -> list[tuple[int, int, int]]:
    """Lengths lacking, segment, and shift of all probes; equal lengths unshifted are what a line also offers."""
    out = []
    for lack in range(k + 1):
        for i in range(k + 1):
            lo, hi = max(-i, lack - (k - i)), min(i, lack + (k - i))
            out += [(lack, i, shift) for shift in range(lo, hi + 1)]
    return out


def segments(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: np.ndarray | None, k: int) -> Iterator[tuple]:
    """All offers and probes: index of the line, key, role, and the part of the line that is within ``rest`` edits of that of a line it should meet.

    ``edits`` are those that each line may differ in; without them the shorter line's budget.
    """
    size = ends - starts
    for e in range(1, k + 1):
        for lack, i, shift in places(e):
            n = size - lack
            # Short segments come first.
            base, more = n // (e + 1), n % (e + 1)
            own = base + (i >= e + 1 - more)
            at = starts + i * base + np.maximum(0, i - (e + 1 - more)) + shift
            ok = np.flatnonzero((n >= 0) & ((budget(n, k) if edits is None else edits) == e) & (at >= starts) & (at + own <= ends))
            at, to = at[ok], (at + own)[ok]
            key = mix(span_hash(prefix, at, to) + n[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((e * 8 + i) * 0x2545F491))
            # Left of segment i there are at most i edits, right of it at most e - i.
            rest = (to, ends[ok], e - i) if i < e else (starts[ok], at, i)
            yield ok, key, OFFERS | PROBES if lack == 0 and shift == 0 else PROBES, *rest


def bags(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of eight kinds of bytes, modulo 16, of each line."""
    out = np.zeros(len(starts), dtype=np.int64)
    kind = _BIN[block.data]
    for b in range(8):
        total = np.concatenate(([0], np.cumsum(kind == b)))
        out |= (total[ends] - total[starts] & 15) << (4 * b)
    return out.astype(np.uint32)


def index_rows(block: Block, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, k: int = EDITS) -> np.ndarray:
    """All offers and probes of the lines."""
    bag = bags(block, starts, ends)
    parts = [np.zeros(0, dtype=ROW)]
    for own, key, role, *_ in segments(block.prefix_hash(block.data), starts, ends, None, k):
        rows = np.empty(len(own), dtype=ROW)
        rows["key"], rows["id"], rows["bag"], rows["role"] = key, ids[own], bag[own], role
        parts.append(rows)
    return np.concatenate(parts)


def bags_within(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Whether counts of eight kinds of bytes (modulo 16) differ by no more than k edits can make them."""
    total = np.zeros(len(x), dtype=np.int64)
    for b in range(8):
        d = ((x >> np.uint32(4 * b)) - (y >> np.uint32(4 * b))) & np.uint32(15)
        total += np.minimum(d, np.uint32(16) - d)
    return total <= 2 * k


def _pairs(rows: np.ndarray, starts: np.ndarray, size: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the groups, which are small, that the roles and bags allow, by group size."""
    for g in np.unique(size):
        at = starts[size == g]
        i, j = np.triu_indices(int(g), 1)
        step = max(1, STEP // len(i))
        for s in range(0, len(at), step):
            x, y = rows[(at[s : s + step, None] + i).ravel()], rows[(at[s : s + step, None] + j).ravel()]
            role = ((x["role"] & OFFERS) & (y["role"] >> 1)) | ((y["role"] & OFFERS) & (x["role"] >> 1))
            ok = (role > 0) & bags_within(x["bag"], y["bag"], k)
            yield x["id"][ok], y["id"][ok]


def _few_pairs(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs of one group that the roles and bags allow, or None if they are more than ALL_PAIRS lines have or ALL_PAIRS / 4 a line."""
    most, n = max(ALL_PAIRS * (ALL_PAIRS - 1) // 2, len(rows) * ALL_PAIRS // 4), 0
    ids, bag, offers = rows["id"], np.ascontiguousarray(rows["bag"]), (rows["role"] & OFFERS) > 0
    probes, own, a, b = (rows["role"] & PROBES) > 0, np.flatnonzero(offers), [], []
    step = max(1, STEP // len(rows))
    for s in range(0, len(own), step):
        x = own[s : s + step]
        # A pair in which both sides offer and probe comes once.
        i, j = np.nonzero(probes & ~(offers & probes[x, None] & (np.arange(len(rows)) <= x[:, None])) & (np.arange(len(rows)) != x[:, None]))
        i = x[i]
        ok = bags_within(bag[i], bag[j], k)
        a.append(ids[i[ok]]), b.append(ids[j[ok]])
        n += len(a[-1])
        if n > most:
            return None
    a, b = np.concatenate([ids[:0], *a]), np.concatenate([ids[:0], *b])
    return np.minimum(a, b), np.maximum(a, b)


def close(a: list[bytes], b: list[bytes], k: int) -> np.ndarray:
    """Whether the pairs are within k edits: bit-vectors of a band of 2k + 1 diagonals, all pairs a step at a time."""
    out = np.zeros(len(a), dtype=bool)
    longest = np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    order = np.argsort(longest, kind="stable")
    s = 0
    while s < len(order):
        own = order[s : s + SIDE_BY_SIDE]
        fit = np.searchsorted(longest[own] * np.arange(1, len(own) + 1), PADDED, side="right")
        own = own[: max(1, int(fit))]
        s += len(own)
        own = own.tolist()
        m, n = np.array([len(a[i]) for i in own]), np.array([len(b[i]) for i in own])
        width = int(max(m.max(), n.max())) + 2 * k + 1
        # Column k + i holds byte i, so that the band never leaves the array; 0 and 1 meet nothing.
        x, y = np.zeros((width + k, len(own)), np.int16), np.full((int(n.max()), len(own)), -1, np.int16)
        for c, i in enumerate(own):
            x[k : k + m[c], c] = np.frombuffer(a[i], np.uint8).astype(np.int16) + 1
            y[: n[c], c] = np.frombuffer(b[i], np.uint8).astype(np.int16) + 1
        one, top = np.uint64(1), np.uint64(1) << np.uint64(2 * k)
        mask = (top << one) - one
        # Bit 2k is the lowest row of the band, j + k in column j; bit 0 the highest, j - k.
        vp = np.full(len(own), (((1 << (k + 1)) - 1) << k) & ((1 << (2 * k + 1)) - 1), np.uint64)
        vn = np.zeros(len(own), np.uint64)
        score = np.full(len(own), k)
        for j in range(int(n.max())):
            eq = np.zeros(len(own), np.uint64)
            for d in range(2 * k + 1):
                eq |= (x[j + d] == y[j]).astype(np.uint64) << np.uint64(d)
            d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
            hp = (vn | ~(d0 | vp)) & mask
            hn = d0 & vp
            below = np.maximum(0, j + 1 + k - m)  # rows of the band below the last one
            live = j < n
            bit = np.minimum(2 * k - below, 2 * k)
            got = bit >= 0
            bit = np.maximum(bit, 0).astype(np.uint64)
            step = np.where(below == 0, ((d0 & top) == 0).astype(np.int64), ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
            score += np.where(live & got, step, 0)
            shifted = d0 >> one
            vp = (hn | ~(shifted | hp)) & mask
            vn = shifted & hp
            if j % 32 == 31 and not ((score <= 3 * k) & live).any():
                break
        out[own] = (score <= k) & (np.abs(m - n) <= k)
    return out


def near_lines(a: list[bytes], b: list[bytes], k: int = EDITS) -> np.ndarray:
    """Whether the pairs are within the budget of their shorter line."""
    edits = budget(np.minimum([len(x) for x in a], [len(x) for x in b]), k) if a else np.zeros(0, np.int64)
    out = np.array([e == 0 and x == y for x, y, e in zip(a, b, edits)], dtype=bool)
    for e in range(1, k + 1):
        own = np.flatnonzero(edits == e)
        if len(own):
            out[own] = close([a[i] for i in own], [b[i] for i in own], e)
    return out


LEVEL = "key long, id long, lo int, hi int, edits int, bag long"


def _level(columns: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, kinds)], names=["key", "id", "lo", "hi", "edits", "bag"])


def _joined(rows: list[bytes]) -> tuple[Block, np.ndarray]:
    block = block_of(pa.array(rows, type=pa.binary()))
    return block, block.offsets[:-1]


def _rests(k: int):
    """Of (id, keys, line): a row for each key with the part of the line that it leaves to be compared."""

    def f(batches):
        for b in batches:
            for at in range(0, len(b), 2000):
                some = b.slice(at, 2000)
                ids, keys = some.column(0).to_numpy(), some.column(1)
                block, first = _joined([x.as_py() for x in some.column(2)])
                wanted = keys.flatten().to_numpy()
                line = np.repeat(np.arange(len(ids)), np.diff(keys.offsets.to_numpy()))
                order = np.lexsort((wanted, line))
                wanted, line = wanted[order], line[order]
                bag = bags(block, first, block.offsets[1:])
                for own, key, _, lo, hi, edits in segments(block.prefix_hash(block.data), first, block.offsets[1:], None, k):
                    key = key.view(np.int64)
                    ok = np.zeros(len(own), dtype=bool)
                    for i in np.unique(line):
                        a, z = np.searchsorted(line, [i, i + 1])
                        here = slice(*np.searchsorted(own, [i, i + 1]))
                        ok[here] = np.isin(key[here], wanted[a:z])
                    own, key, lo, hi = own[ok], key[ok], lo[ok], hi[ok]
                    yield _level([key, ids[own], lo - first[own], hi - first[own], np.full(len(own), edits), bag[own]])
        trim()

    return f


def _again(k: int):
    """Of rows of LEVEL with their line: the rests cut into segments, under keys that hold the key so far."""

    def f(batches):
        for b in batches:
            key, ids, lo, hi, edits, bag = (b.column(i).to_numpy() for i in range(6))
            block, first = _joined([x.as_py() for x in b.column(6)])
            for own, sub, _, a, z, rest in segments(block.prefix_hash(block.data), first + lo, first + hi, edits, k):
                yield _level([mix(key[own].view(np.uint64) ^ mix(sub)).view(np.int64), ids[own], a - first[own], z - first[own], np.full(len(own), rest), bag[own]])
        trim()

    return f


def _both_ways(batches):
    """Of rows of LEVEL with their line: key, rest, id, line, and the same with the rest turned round."""
    for b in batches:
        key, lo, hi = b.column(0).to_numpy(), b.column(2).to_pylist(), b.column(3).to_pylist()
        text = [x.as_py() for x in b.column(6)]
        rest = [x[a:z] for x, a, z in zip(text, lo, hi)]
        for own, way in ((key, rest), (~key, [x[::-1] for x in rest])):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(way, type=pa.binary()), b.column(1), pa.array(text, type=pa.binary())], names=["key", "rest", "id", "line"])


def _neighbours(k: int):
    """Of (key, rest, id, line) in order: pairs of rows beside each other under one key that are within the budget."""

    def f(batches):
        last = None
        for b in batches:
            key, ids, text = b.column(0).to_pylist(), b.column(2).to_pylist(), [x.as_py() for x in b.column(3)]
            if last is not None:
                key, ids, text = [last[0], *key], [last[1], *ids], [last[2], *text]
            if key:
                last = key[-1], ids[-1], text[-1]
            at = [i for i in range(len(key) - 1) if key[i] == key[i + 1] and ids[i] != ids[i + 1]]
            at = np.array(at, dtype=np.int64)[near_lines([text[i] for i in at], [text[i + 1] for i in at], k)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], type=pa.int64()), pa.array([ids[i + 1] for i in at], type=pa.int64())], names=["a", "b"])

    return f


def _cell_pairs(k: int):
    """Of the rows of cells: pairs of different roots that the bags allow."""

    def f(batches):
        got = list(batches)
        if not sum(map(len, got)):
            return
        got = pa.Table.from_batches(got)
        c = {name: got[name].to_numpy() for name in got.column_names}
        order = np.lexsort((c["y"], c["x"], c["key"]))
        c = {name: x[order] for name, x in c.items()}
        cell = np.cumsum(np.append(False, (c["key"][1:] != c["key"][:-1]) | (c["x"][1:] != c["x"][:-1]) | (c["y"][1:] != c["y"][:-1])))
        bag = c["bag"].astype(np.uint32)
        found = []
        for i, j in spread_pairs(np.arange(len(cell)) + 1, np.searchsorted(cell, cell, side="right"), STEP):
            ok = (c["root"][i] != c["root"][j]) & ((c["x"][i] == c["y"][i]) | (c["own"][i] != c["own"][j]))
            i, j = i[ok], j[ok]
            ok = bags_within(bag[i], bag[j], k)
            a, b = c["id"][i[ok]], c["id"][j[ok]]
            found.append(unique_pairs(np.minimum(a, b), np.maximum(a, b)))
        if found:
            a, b = unique_pairs(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
            del found, got, c
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])
        trim()

    return f


def _verified(pairs: DataFrame, of: DataFrame, k: int) -> DataFrame:
    """Those pairs (a, b) of lines (lid, line) that are within the budget; a table read back from disk."""

    def f(batches):
        for b in batches:
            ok = pa.array(near_lines([x.as_py() for x in b.column(2)], [y.as_py() for y in b.column(3)], k))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])
        trim()

    both = pairs.join(of.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(of.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(f, "a long, b long"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """lid and line of the wanted lids, which are many: the documents stay where they are, lines that a filter of bits lets pass are joined; a table read back from disk."""
    mask = (1 << FILTER_BITS) - 1
    at = wanted.select(F.col("lid").bitwiseAND(F.lit(mask).cast("long")).cast("int").alias("at")).distinct().toArrow()["at"].to_numpy()
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def f(batches):
        bits, seen = shared.value, np.zeros(0, np.int64)
        for b in batches:
            for block in blocks(b.column(0)):
                starts, ends, _, _, lid = hashed_lines(block)
                own, first = np.unique(lid, return_index=True)
                slot = own & mask
                ok = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0) & (ends[first] - starts[first] >= EDIT_BYTES)
                own, first = own[ok], first[ok]
                new = ~np.isin(own, seen, assume_unique=True)
                own, first, seen = own[new], first[new], np.union1d(seen, own)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([block.data[s:e].tobytes() for s, e in zip(starts[first], ends[first])], type=pa.binary())], names=["lid", "line"])
        trim()

    out = cut(semi(docs.select("text").mapInArrow(f, "lid long, line binary"), wanted, "lid").dropDuplicates(["lid"]))
    shared.destroy()
    return out


def _connected(near: DataFrame, large: DataFrame, of: DataFrame, k: int) -> DataFrame:
    """near and what it takes to connect all close pairs of the large segments' rows (key, id)."""
    lines_of = of.select(F.col("lid").alias("id"), "line")
    rows = cut(large.groupBy("id").agg(F.collect_set("key").alias("keys")).join(lines_of, "id").mapInArrow(_rests(k), LEVEL).distinct())
    for depth in range(DEPTH + 1):
        if not rows.limit(1).count():
            break
        with_line = rows.join(lines_of, "id").select("key", "id", "lo", "hi", "edits", "bag", "line")
        beside_rows = cut(with_line.mapInArrow(_both_ways, "key long, rest binary, id long, line binary"))
        near = near.unionByName(cut(beside_rows.repartitionByRange("key", "rest").sortWithinPartitions("key", "rest", "id").mapInArrow(_neighbours(k), "a long, b long").distinct()))
        roots = components(near).withColumnRenamed("root", "_root")
        rooted = lambda df: df.join(beside(roots), "id", "left").withColumn("root", F.coalesce("_root", "id")).drop("_root")  # noqa: B023, E731
        mixed = lambda df: df.groupBy("key").agg(F.count_distinct("id").alias("n"), F.min("root").alias("lo_root"), F.max("root").alias("hi_root")).where("lo_root <> hi_root").select("key", "n")
        open_ = cut(semi(rooted(rows), mixed(rooted(rows)), "key"))
        if depth < DEPTH:
            sub = open_.join(lines_of, "id").select("key", "id", "lo", "hi", "edits", "bag", "line").mapInArrow(_again(k), LEVEL).distinct()
            sub = rooted(cut(sub))
            sub = cut(sub.join(beside(mixed(sub)), "key"))
            few, rows = sub.where(F.col("n") <= ALL_PAIRS), sub.where(F.col("n") > ALL_PAIRS).select("key", "id", "lo", "hi", "edits", "bag")
        else:
            few, rows = open_, open_.limit(0)
        pairs = cells(few.select("key", "id", "bag", "root").distinct(), ["root", "id", "bag"]).mapInArrow(_cell_pairs(k), "a long, b long").distinct()
        near = near.unionByName(_verified(cut(pairs), of, k))
    return near


OCCURRENCE = ["doc_id", "text_hash", "line_no"]


def repeated_lines(docs: DataFrame, k: int = EDITS) -> DataFrame:
    """All occurrences of lines that repeat an earlier one: doc_id, text_hash, line_no, line_bytes, keep_doc_id, keep_text_hash, keep_line_no.

    Lines are numbered from 0 by line feeds; blanks around a line don't count, nor do blank lines.  text_hash is
    xxhash64 of the text, so that texts under one doc_id are told apart; rows that repeat in both are one document.
    Of equal claims the lesser doc_id, then text_hash, then line number stays.  Texts that are null or empty and rows
    without doc_id have no lines.  Other columns of docs aren't read.  A table in the shared folder.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    tasks = bucket_count(spark, docs)

    def find(batches):
        for b in batches:
            for block in blocks(b.column(1)):
                starts, ends, text, number, lid = hashed_lines(block)
                at = pa.array(text + block.first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(number.astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(lid)], names=[*OCCURRENCE, "line_bytes", "lid"])

    def offer(batches):
        seen = np.zeros(0, np.int64)
        for b in batches:
            for block in blocks(b.column(1), (2 << 20) - 1):
                starts, ends, _, _, lid = hashed_lines(block)
                own, at = np.unique(lid, return_index=True)
                new = ~np.isin(own, seen, assume_unique=True) & (ends[at] - starts[at] >= EDIT_BYTES)
                at, seen = at[new], np.union1d(seen, own[new])
                yield from parcels(index_rows(block, starts[at], ends[at], lid[at], k), tasks * FINE)
        trim()

    def meet(batches):
        rows = unpack(batches, ROW)
        if len(rows):  # a line's rows of one key are one
            at = np.flatnonzero(np.append(True, (rows["key"][1:] != rows["key"][:-1]) | (rows["id"][1:] != rows["id"][:-1])))
            role = np.bitwise_or.reduceat(rows["role"], at)
            rows = rows[at]
            rows["role"] = role
        rows, starts, size = groups(rows)
        few = size <= ALL_PAIRS
        parts = [p for p in _pairs(rows, starts[few], size[few], k) if len(p[0])]
        for i in np.flatnonzero((size > ALL_PAIRS) & (size <= TRIED)):
            if (got := _few_pairs(rows[starts[i] : starts[i] + size[i]], k)) is not None:
                parts.append(got)
                few[i] = True
        large = rows[np.repeat(~few, size)]
        if parts:
            a, b = unique_pairs(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
            for i in range(0, len(a), 100_000):
                n = len(a[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + n]), pa.array(b[i : i + n]), pa.nulls(n, pa.int64())], names=["a", "b", "key"])
        for i in range(0, len(large), 100_000):
            x = large[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x["id"]), pa.nulls(len(x), pa.int64()), pa.array(x["key"].view(np.int64))], names=["a", "b", "key"])
        del rows, large, parts
        trim()

    def fetch(batches):
        for b in batches:
            lists = b.column(1)
            for block in blocks(b.column(0)):
                starts, ends, text, _, lid = hashed_lines(block)
                at = [np.zeros(0, np.int64)]
                bounds = np.searchsorted(text, np.arange(len(block) + 1))
                for i in range(len(block)):
                    mine = np.arange(bounds[i], bounds[i + 1])
                    at.append(mine[np.isin(lid[mine], lists[block.first + i].values.to_numpy())])
                at = np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array(lid[at]), pa.array([block.data[s:e].tobytes() for s, e in zip(starts[at], ends[at])], type=pa.binary())], names=["lid", "line"])

    with scratch(spark), lean(spark):
        found = cut(docs.mapInArrow(find, "doc_id long, text_hash long, line_no int, line_bytes int, lid long"))
        met = cut(send(docs.select("doc_id", "text").mapInArrow(offer, "bucket int, packed binary"), tasks).mapInArrow(meet, "a long, b long, key long"))
        tidy(spark)
        pairs = cut(met.where("b is not null").select("a", "b").distinct())
        large = met.where("b is null").select("key", F.col("a").alias("id"))
        at = F.struct(*OCCURRENCE)
        first = found.groupBy("lid").agg(F.min(at).alias("first"), F.max(at).alias("last"))
        # The texts of the lines that met, each from its first document if they are few.
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("lid")).union(large.select("id")).distinct())
        if small(wanted, FEW_TEXTS):
            wanted = cut(semi(first, wanted, "lid").groupBy("first.doc_id", "first.text_hash").agg(F.collect_list("lid").alias("lids")))
            of = cut(docs.join(beside(wanted), ["doc_id", "text_hash"]).select("text", "lids").mapInArrow(fetch, "lid long, line binary").dropDuplicates(["lid"]))
        else:
            of = _texts(docs, wanted)
        near = _verified(pairs, of, k)
        tidy(spark)
        if large.limit(1).count():
            near = _connected(near, large, of, k)
        roots = components(near)
        of_line = first.join(beside(roots.withColumnRenamed("id", "lid")), "lid", "left").select("lid", F.coalesce("root", "lid").alias("root"), "first", "last")
        by = of_line.groupBy("root").agg(F.min("first").alias("keep"), F.max("last").alias("last")).where("keep <> last").select("root", "keep")
        repeats = cut(of_line.select("lid", "root").join(by, "root").select("lid", "keep"))
        return keep(
            found.join(beside(repeats), "lid").where(at != F.col("keep")).distinct()
            .select(*OCCURRENCE, "line_bytes", *[F.col(f"keep.{c}").alias(f"keep_{c}") for c in OCCURRENCE])
        )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repeated lines of the documents; rows as repeated_lines says."""
    return repeated_lines(table(spark, sf_dir, "documents"))


def _row(doc_id: str, text_hash: str) -> Column:
    return F.xxhash64(doc_id, text_hash)


def _without(text: str, numbers: Column) -> Column:
    """The text without the lines of these numbers."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.array_join(F.transform(F.filter(numbered, lambda s: ~F.array_contains(numbers, s["i"])), lambda s: s["x"]), "\n")


def _copies(docs: DataFrame, repeats: DataFrame, t: float) -> DataFrame:
    """Documents that are near copies of the one that keeps most of their repeated lines: row and original, as _row gives them.

    Both are compared as they would be left: the copy without its lines that others keep, the original without all its repeated lines.
    """
    spans = repeats.where("row <> original_row").groupBy("row", F.col("original_row").alias("original")).agg(F.sum("line_bytes").alias("n"))
    best = cut(spans.groupBy("row").agg(F.max_by("original", F.struct("n", "original")).alias("original")))
    lost = repeats.join(beside(best), "row", "left").groupBy("row").agg(
        F.collect_set("line_no").alias("all"), F.collect_set(F.when(F.col("original_row").eqNullSafe(F.col("original")), None).otherwise(F.col("line_no"))).alias("others"))
    lost = cut(lost.join(beside(best), "row", "full"))
    none = F.array().cast("array<int>")
    left = docs.join(beside(lost.where("original is not null")), "row").select(F.col("row").alias("id"), _without("text", F.coalesce("others", none)).alias("text"), F.array(F.bitwise_not("original")).alias("targets"))
    right = semi(docs, best.select(F.col("original").alias("row")).distinct(), "row").join(beside(lost.select("row", "all")), "row", "left")
    right = right.select(F.bitwise_not("row").alias("id"), _without("text", F.coalesce("all", none)).alias("text"), F.array(F.bitwise_not("row")).alias("targets"))
    near = jaccard.verify(jaccard.moved_sets(left.unionByName(right), jaccard.N), t)
    return cut(near.select(F.col("b").alias("row"), F.bitwise_not("a").alias("original")).distinct())


def without_repeats(docs: DataFrame, t: float = jaccard.THRESHOLD) -> DataFrame:
    """The documents without their repeated lines; ``n_chars`` follows the text.

    A document that is verified to be a near copy (n-gram Jaccard similarity t) of the one that keeps most of its
    repeated lines keeps those lines, as copies are judged as documents; a line that only copies would keep stays in
    the first other document.  A document of nothing but repeated lines is left with an empty text.  Documents without
    doc_id or text stay as they are, rows that repeat are treated alike.
    """
    spark = docs.sparkSession
    with scratch(spark):
        repeats = repeated_lines(docs)
        repeats = cut(repeats.select(_row("doc_id", "text_hash").alias("row"), "line_no", "line_bytes", _row("keep_doc_id", "keep_text_hash").alias("original_row"), F.col("keep_line_no").alias("original_line"), F.struct(*OCCURRENCE).alias("at")))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
        with lean(spark):
            copies = _copies(rows.select(F.xxhash64("doc_id", F.xxhash64("text")).alias("row"), "text"), repeats, t)
        by_copies = semi(semi(repeats, copies.select(F.col("row").alias("original_row")), "original_row"), copies.select("row"), "row", keep=False)
        spared = cut(by_copies.groupBy("original_row", "original_line").agg(F.min("at").alias("at")).select("at"))
        dropped = semi(repeats, spared, "at", keep=False).join(beside(copies), "row", "left").where("original is null or original <> original_row")
        drop = keep(dropped.groupBy("at.doc_id", "at.text_hash").agg(F.collect_set("line_no").alias("numbers")).select(F.col("doc_id").alias("__lodestar_doc"), F.col("text_hash").alias("__lodestar_hash"), F.col("numbers").alias("__lodestar_drop")))
    out = docs.join(beside(drop), (F.col("doc_id").cast("long") == F.col("__lodestar_doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__lodestar_hash")), "left")
    cuts = F.col("__lodestar_drop").isNotNull()
    out = out.withColumn("__lodestar_text", F.when(cuts, _without("text", F.col("__lodestar_drop"))).otherwise(F.col("text")))
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    n_chars = [F.when(cuts, F.length("__lodestar_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")] if "n_chars" in docs.columns else []
    return out.select(*names, F.col("__lodestar_text").alias("text"), *n_chars).select(docs.columns)


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated lines, as without_repeats says; all rows and columns stay."""
    return without_repeats(docs)
