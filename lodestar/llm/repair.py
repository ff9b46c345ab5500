"""Token-id output, compressed by a Re-Pair grammar per shard.

Texts become token ids of a public byte-level vocabulary.  Per shard the
most frequent pairs of neighbouring ids are replaced by nonterminals again
and again, in rounds: the first takes the pairs that are at least a share of
the most frequent one's count, each further one pairs down to that share of
the bound before, the more frequent first where two overlap.  It ends when no
pair is so frequent that its rule pays: a rule takes three numbers (its two
sides and its length) and saves one for each place.  Rules and
expansion lengths are stored with the shard, so any token range of any
document decodes without expanding the rest.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHARD_TOKENS = 1_000_000
#: From round to round pairs that are FALL times rarer are taken; one that is rarer than LEAST_COUNT doesn't pay for its rule.
FALL = 4
LEAST_COUNT = 4
SLOT_BITS = 20
_SPREAD = np.int64(-7046029254386353131)


@lru_cache(maxsize=2)
def encoder_of(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    # Texts that contain it are ordinary; but where there is no special token, tiktoken looks for one at every character.
    special = {"<|endoftext|>": max(ranks.values()) + 1}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def encoder(path: str):
    with open(path, "rb") as f:
        return encoder_of(f.read())


def tokens(texts: pa.Array, enc) -> list[np.ndarray]:
    """Ids of each text; none for a null."""
    none = np.zeros(0, dtype=np.uint32)
    return [enc.encode_to_numpy(x, disallowed_special=()) if x else none for x in texts.to_pylist()]


def _slots(code: np.ndarray) -> np.ndarray:
    return ((code * _SPREAD).view(np.uint64) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def compress(ids: np.ndarray, bounds: np.ndarray, terminals: int, fall: int = FALL, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their document bounds, and the rules: nonterminal ``terminals + r`` stands for the pair ``rules[r]``.

    A pair never spans two documents.  At the end no pair of neighbours can be replaced in ``least`` places.  Of
    equally frequent pairs that overlap, that of the higher slot goes first.
    """
    seq = np.array(ids, dtype=np.int64)
    head = np.zeros(len(seq) + 1, dtype=bool)
    head[np.asarray(bounds)] = True
    head = head[:-1]
    rules: list[np.ndarray] = []
    symbols, floor = terminals, 0
    while len(seq) > 1 and floor != least:
        code = (seq[:-1] << 32) | seq[1:]
        slot = _slots(code)
        slot[head[1:]] = 1 << SLOT_BITS  # no pair across documents
        count = np.bincount(slot, minlength=(1 << SLOT_BITS) + 1)
        count[-1] = 0
        floor = max(least, (floor or int(count.max())) // fall)
        able = np.flatnonzero((count >= floor)[slot])  # a table of bytes stays in the cache, one of numbers doesn't
        # Pairs that share a slot: one of them stands for it in this round, the others wait.
        own = slot[able]
        stands = np.empty(len(count), dtype=np.int64)
        stands[own] = code[able]
        same = stands[own] == code[able]
        able, own = able[same], own[same]
        number = np.bincount(own, minlength=len(count))
        rank = np.zeros(len(seq) + 1, dtype=np.int64)  # rank[i + 1] belongs to position i
        rank[able + 1] = (number[own] << SLOT_BITS | own) * (number[own] >= floor)
        mine = rank[able + 1]
        ahead = (mine > 0) & (mine > rank[able]) & (mine >= rank[np.minimum(able + 2, len(seq))])
        at, own = able[ahead], own[ahead]
        good = np.bincount(own, minlength=len(count))[own] >= least
        at, own = at[good], own[good]
        used = np.zeros(len(count), dtype=bool)
        used[own] = True
        each = np.flatnonzero(used)
        got = stands[each]
        rules.append(np.column_stack((got >> 32, got & 0xFFFFFFFF)))
        count[each] = np.arange(symbols, symbols + len(each))  # the counts are done with: now it has the new symbols
        seq[at] = count[own]
        symbols += len(got)
        left = np.ones(len(seq), dtype=bool)
        left[at + 1] = False
        stay = np.flatnonzero(left)
        seq, head = seq[stay], head[stay]
    if len(seq) > 1:
        seq, head, more = _finish(seq, head, symbols, least)
        rules += more
    new_bounds = np.append(np.flatnonzero(head), len(seq))
    full = np.asarray(bounds)
    # Empty documents have no head of their own.
    starts = np.searchsorted(np.unique(full[full < len(ids)]), full) if len(ids) else np.zeros(len(full), dtype=np.int64)
    return seq, new_bounds[starts], np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)


def _finish(seq: np.ndarray, head: np.ndarray, symbols: int, least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Replaces pairs until none is left in ``least`` places: by exact counts, and only where something changed.

    Symbols are linked, so that a replaced pair leaves a hole; a pair that becomes frequent has a new symbol, so it
    lies beside a place that was replaced.
    """
    n = len(seq)
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.append(head[1:], True)  # no pair begins at a document's last symbol
    hole = np.zeros(n, dtype=bool)
    rules: list[np.ndarray] = []
    # A turn resets the entries of these that it has set: most turns are about few places.
    rank, odd, near = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=bool), np.zeros(n, dtype=bool)
    able = np.flatnonzero(~ends)
    # A pair isn't more frequent than its slot: where that has fewer than ``least`` places, nothing is sorted.
    slot = _slots((seq[able] << 32) | seq[able + 1])
    able = able[(np.bincount(slot, minlength=1 << SLOT_BITS) >= least)[slot]]
    while True:
        able = able[~hole[able] & ~ends[able]]
        code = (seq[able] << 32) | seq[following[able]]
        kinds, of, times = np.unique(code, return_inverse=True, return_counts=True)
        some = times[of] >= least
        able, of = able[some], of[some]
        if not len(able):
            break
        mine = (times[of] << 32) | (of + 1)
        rank[able] = mine
        # The more frequent of two that overlap; of a run of one pair every other place, from its start.
        first = rank[before[able]] < mine  # before[0] is the last place of rank, which is none
        at, own = able, of
        twin = rank[before[able]] == mine
        if twin.any():
            run = np.cumsum(~twin)
            start = np.flatnonzero(~twin)
            step = np.arange(len(able)) - start[run - 1]
            first = (first[start][run - 1]) & (step % 2 == 0)
            odd[able] = step % 2 == 1
        after = rank[following[able]]
        take = first & ((after <= mine) | odd[following[able]] & (after == mine))
        rank[able], odd[able] = 0, False
        at, own = able[take], of[take]
        enough = np.bincount(own, minlength=len(kinds)) >= least
        good = enough[own]
        at, own = at[good], own[good]
        if not len(at):
            # Overlaps hold all of them back: the most frequent pair goes alone, from left to right.
            best = int(np.argmax(np.where(np.bincount(of, minlength=len(kinds)) > 0, times, 0)))
            mine_at = able[of == best]
            pick, last = [], -1
            for i in mine_at.tolist():
                if i != last:
                    pick.append(i)
                    last = int(following[i])
            if len(pick) < least:
                able = able[of != best]
                continue
            at, own = np.array(pick), np.full(len(pick), best)
            enough = np.zeros(len(kinds), dtype=bool)
            enough[best] = True
        used = np.zeros(len(kinds), dtype=bool)
        used[own] = True
        got = kinds[used]
        rules.append(np.column_stack((got >> 32, got & 0xFFFFFFFF)))
        seq[at] = symbols + (np.cumsum(used) - 1)[own]
        symbols += len(got)
        gone = following[at]
        hole[gone] = True
        ends[at] = ends[gone]
        to = following[gone]
        following[at] = to
        inside = to < n
        before[to[inside]] = at[inside]
        for some in (able, at, before[at][before[at] >= 0]):
            near[some] = True
        able = np.flatnonzero(near)
        near[able] = False
    return seq[~hole], head[~hole], rules


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """Tokens that each nonterminal stands for."""
    out = np.zeros(len(rules), dtype=np.int64)
    ready = np.zeros(len(rules), dtype=bool)
    while not ready.all():
        sides = [np.where(rules[:, k] < terminals, 1, out[np.maximum(rules[:, k] - terminals, 0)]) for k in (0, 1)]
        known = [np.where(rules[:, k] < terminals, True, ready[np.maximum(rules[:, k] - terminals, 0)]) for k in (0, 1)]
        ready = known[0] & known[1]
        out = np.where(ready, sides[0] + sides[1], 0)
    return out


def decode(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int, first: int = 0, count: int | None = None) -> list[int]:
    """Tokens first .. first+count of a document's symbols; what lies outside is skipped by expansion lengths."""
    sizes = np.where(symbols < terminals, 1, lengths[np.maximum(symbols - terminals, 0)] if len(lengths) else 1)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    last = total if count is None else min(total, first + count)
    out: list[int] = []
    k = int(np.searchsorted(ends, first, side="right"))
    at = int(ends[k - 1]) if k else 0
    while at < last:
        stack = [int(symbols[k])]
        while stack and at < last:
            s = stack.pop()
            size = 1 if s < terminals else int(lengths[s - terminals])
            if at + size <= first:
                at += size
            elif s < terminals:
                out.append(s)
                at += 1
            else:
                stack += [int(rules[s - terminals, 1]), int(rules[s - terminals, 0])]
        k += 1
    return out


SCHEMA = (
    "shard long, doc_ids array<long>, n_tokens long, n_symbols long, doc_starts array<int>, terminals int, rules binary, lengths binary, symbols binary"
)


def write_shards(docs: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row a shard of about shard_tokens tokens: documents in order, symbol starts, rules, lengths, symbols.

    Binary columns are little-endian uint32.  A null or empty text is a document of no tokens; a null doc_id
    stays null; repeated rows are stored each; a long document is one shard with its neighbours, never cut.
    The vocabulary file is read by the driver and travels with the job.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def write(batches):
        enc = encoder_of(shared.value)
        terminals = enc.max_token_value + 1
        part, number, have = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            symbols, starts, rules = compress(flat, np.concatenate(([0], np.cumsum([len(x) for x in parts]))), terminals)
            lengths = expansion_lengths(rules, terminals)
            raw = [x.astype("<u4").tobytes() for x in (rules, lengths, symbols)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) | number]), pa.array([pa.concat_arrays(ids).to_pylist()], type=pa.list_(pa.int64())), pa.array([len(flat)]), pa.array([len(symbols)]),
                    pa.array([starts.tolist()], type=pa.list_(pa.int32())), pa.array([terminals], type=pa.int32()), *[pa.array([x], type=pa.binary()) for x in raw],
                ],
                names=["shard", "doc_ids", "n_tokens", "n_symbols", "doc_starts", "terminals", "rules", "lengths", "symbols"],
            )

        for b in batches:
            at = 0
            while at < len(b):
                some = b.slice(at, 128)
                ids.append(some.column(0))
                new = tokens(some.column(1), enc)
                parts += new
                have += sum(map(len, new))
                at += len(some)
                if have >= shard_tokens:
                    yield flush()
                    number, have, ids, parts = number + 1, 0, [], []
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, SCHEMA)


def read_documents(shards: DataFrame) -> DataFrame:
    """Back to doc_id and token ids."""

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                symbols = np.frombuffer(row["symbols"], "<u4").astype(np.int64)
                starts = row["doc_starts"]
                out = [decode(symbols[a:z], rules, lengths, row["terminals"]) for a, z in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], type=pa.int64()), pa.array(out, type=pa.list_(pa.int64()))], names=["doc_id", "tokens"])

    return shards.mapInArrow(read, "doc_id long, tokens array<long>")


def op8_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as compressed token ids; rows as write_shards says."""
    return write_shards(table(spark, sf_dir, "documents"))
