"""License scan by diagonal voting.

All rolling hashes of k words are joined by Spark to the positions of the
same hashes in license templates; each match votes for the diagonal
``document position - template position``.  Votes are aggregated by
diagonal, neighbouring diagonals (words added or lost) are merged, and each
merged span is verified by word edit distance against the template.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import block_of, blocks
from .common import beside, keep, scratch, small, table

K = 3
#: Words by which neighbouring diagonals differ, and words between two ranges of one span.
DRIFT, GAP = 4, 12

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT), ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC), ("BSD", _BSD), ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]


def template_words(templates: list[tuple[str, str]]) -> list[np.ndarray]:
    block = block_of(pa.array([t for _, t in templates], type=pa.string()))
    hashes, bounds = block.word_hashes(), block.words()[2]
    return [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def template_positions(spark: SparkSession, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """hash, template number, word position."""
    block = block_of(pa.array([t for _, t in templates], type=pa.string()))
    grams, bounds = block.grams(k)
    rows = [(int(g), t, p) for t in range(len(templates)) for p, g in enumerate(grams[bounds[t] : bounds[t + 1]].view(np.int64))]
    return spark.createDataFrame(rows, "hash long, template int, at int")


def rolling_hashes(docs: DataFrame, templates: list[tuple[str, str]], k: int = K) -> DataFrame:
    """doc_id, text_hash, word position, hash: all rolling hashes that can meet a template, of (doc_id, text, text_hash).

    A 2 MB bitmap of the templates' hashes, broadcast, drops hashes before they become rows; it lets
    everything through that the join could match.
    """
    grams, _ = block_of(pa.array([t for _, t in templates], type=pa.string())).grams(k)
    seen = np.zeros(1 << 24, dtype=bool)
    seen[(grams >> np.uint64(40)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(seen))

    def roll(batches):
        bits = np.unpackbits(shared.value).view(bool)
        for b in batches:
            for block in blocks(b.column(1)):
                h, bounds = block.grams(k)
                hit = np.flatnonzero(bits[(h >> np.uint64(40)).astype(np.int64)])
                text = np.searchsorted(bounds, hit, side="right") - 1
                at = pa.array(text + block.first)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(2).take(at), pa.array((hit - bounds[text]).astype(np.int32)), pa.array(h[hit].view(np.int64))],
                    names=["doc_id", "text_hash", "pos", "hash"],
                )

    return docs.select("doc_id", "text", "text_hash").mapInArrow(roll, "doc_id long, text_hash long, pos int, hash long")


TEXT = ["doc_id", "text_hash", "template"]


def spans(docs: DataFrame, templates: list[tuple[str, str]], k: int = K, drift: int = DRIFT, gap: int = GAP) -> DataFrame:
    """Unverified spans: votes by diagonal; diagonals no more than ``drift`` apart are neighbours, and those of a
    neighbourhood are one span where their word ranges are within ``gap`` words.  One row a span, with its diagonals."""
    at = template_positions(docs.sparkSession, templates, k)
    at = F.broadcast(at) if small(at) else at
    votes = rolling_hashes(docs, templates, k).join(at, "hash").select(*TEXT, "pos", "at").distinct()
    diagonals = votes.groupBy(*TEXT, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("*").cast("int").alias("votes"), F.min("pos").alias("lo"), (F.max("pos") + k).alias("hi"), F.min("at").alias("t_lo"), (F.max("at") + k).alias("t_hi")
    )
    by_diagonal = W.partitionBy(*TEXT).orderBy("diagonal")
    near = diagonals.withColumn("hood", F.sum(F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > drift, F.lit(True)).cast("int")).over(by_diagonal))
    by_place = W.partitionBy(*TEXT, "hood").orderBy("lo", "hi", "diagonal")
    so_far = F.max("hi").over(by_place.rowsBetween(W.unboundedPreceding, -1))
    parts = near.withColumn("part", F.sum(F.coalesce(F.col("lo") - so_far > gap, F.lit(True)).cast("int")).over(by_place))
    return parts.groupBy(*TEXT, "hood", "part").agg(F.sort_array(F.collect_list(F.struct("votes", "lo", "hi", "t_lo", "t_hi"))).alias("diagonals"))


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Word edit distance, a row at a time."""
    row = np.arange(len(b) + 1)
    ramp = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(np.concatenate(([i], step)) - ramp) + ramp
    return int(row[-1])


def best_span(words: np.ndarray, template: np.ndarray, diagonals: list[tuple[int, ...]], similarity: float, least: int) -> tuple | None:
    """The widest span of the diagonals (votes, lo, hi, t_lo, t_hi) that is similar enough: those of the fewest votes are left out one by one."""
    own = sorted(diagonals, key=lambda d: (-d[0], *d[1:]))
    while own:
        lo, hi, t_lo, t_hi = min(d[1] for d in own), min(max(d[2] for d in own), len(words)), min(d[3] for d in own), min(max(d[4] for d in own), len(template))
        if t_hi - t_lo < least:
            return None
        alike = 1 - edit_distance(words[lo:hi], template[t_lo:t_hi]) / max(t_hi - t_lo, hi - lo, 1)
        if alike >= similarity:
            return lo, hi, (t_hi - t_lo) / len(template), alike
        own.pop()
    return None


def outermost(passages: list[tuple]) -> list[tuple]:
    """The passages (template, lo, hi, coverage, similarity) that don't lie within another; of equal ranges the most similar, then the first template."""
    out: list[tuple] = []
    for p in sorted(passages, key=lambda p: (p[1] - p[2], -p[4], p[0])):
        if not any(q[1] <= p[1] and p[2] <= q[2] for q in out):
            out.append(p)
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = K, similarity: float = 0.8, least_words: int = 8) -> DataFrame:
    """Verified license passages: doc_id, text_hash (xxhash64 of the text), license, template, word range, share of the template's words, similarity.

    A passage holds at least least_words words of the template, or all of a shorter one, and is similar
    to that part of it.  A passage within a longer one isn't reported, passages that overlap in part are reported each;
    of equally voted diagonals the first in the text goes first.  Texts that are null, empty or shorter than k words have none; rows that repeat
    in full count once, texts under one doc_id are told apart; rows without doc_id are left out.  Other columns of
    docs aren't read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    sizes = [len(x) for x in template_words(templates)]
    with scratch(spark):
        found = spans(docs, templates, k)
        per_doc = keep(found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("template", "hood", "part", "diagonals"))).alias("spans")))
    shared = spark.sparkContext.broadcast(templates)

    def verify(batches):
        words = template_words(shared.value)
        names = [n for n, _ in shared.value]
        for b in batches:
            ids, hashes, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            rows = []
            for block in blocks(b.column(2)):
                h, bounds = block.word_hashes(), block.words()[2]
                for i in range(len(block)):
                    own, n = h[bounds[i] : bounds[i + 1]], block.first + i
                    passages = []
                    for s in lists[n]:
                        t = s["template"]
                        least = min(least_words, sizes[t]) if sizes[t] > k else sizes[t]
                        if got := best_span(own, words[t], [tuple(d.values()) for d in s["diagonals"]], similarity, least):
                            passages.append((t, *got))
                    rows += [(ids[n], hashes[n], names[p[0]], *p) for p in outermost(passages)]
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds)], names=["doc_id", "text_hash", "license", "template", "word_start", "word_end", "coverage", "similarity"])

    return (
        docs.join(beside(per_doc), ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "spans")
        .mapInArrow(verify, "doc_id long, text_hash long, license string, template int, word_start int, word_end int, coverage double, similarity double").distinct()
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License passages of all documents; rows as scan says."""
    return scan(table(spark, sf_dir, "documents"))
