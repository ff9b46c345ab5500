"""Toxic terms by Levenshtein automata over a lexicon trie, weighed by context.

The lexicon is learned from labelled rows: terms and stems that toxic
documents have and clean ones lack, chosen by how many toxic documents they
explain.  A Levenshtein automaton run along the lexicon trie finds words
within one edit of a term, a swap of two neighbours being one.  What such a
hit weighs is fitted by term: as much as the term itself if no clean labelled
document has a word so near it, else half.  Hits inside quotation marks or after words of
reporting count little, hits near other hits count more; a document whose
hits add up to ``CUT`` is toxic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, block_of, blocks, span_hash
from .common import beside, cut, scratch, table

FIT_ROWS = 12_000
CUT = 1.0
EXACT, NEAR, QUOTED, TOGETHER = 1.0, 0.5, 0.25, 0.25
WINDOW = 8
#: Terms from which words one edit away count; shorter ones have too many ordinary neighbours.
FUZZY_LENGTH = 5
REPORTING = {"said", "says", "called", "wrote", "writes", "word", "term", "quote", "quoted", "reported", "sagte", "nannte", "schrieb", "dijo", "llamó", "escribió", "disait", "appelé", "écrit"}
_STEM = 4


class Trie:
    """Lexicon trie; a node may end a term or, for a stem, accept whatever follows."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.open: list[bool] = [False]

    def add(self, term: str, stem: bool = False) -> None:
        at = 0
        for c in term:
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.term.append(None)
                self.open.append(False)
            at = self.next[at][c]
        self.term[at] = term
        self.open[at] |= stem

    def exact(self, word: str) -> str | None:
        at, stem = 0, None
        for c in word:
            at = self.next[at].get(c, -1)
            if at < 0:
                return stem
            if self.open[at]:
                stem = self.term[at]
        return self.term[at] or stem

    def near(self, word: str, k: int = 1, least: int = FUZZY_LENGTH) -> str | None:
        """A term within k edits: the Levenshtein automaton of the word, its states as rows of distances, walks the trie."""
        n = len(word)
        best: tuple[int, str] | None = None
        stack = [(0, 0, list(range(n + 1)), None, "")]
        while stack:
            at, depth, row, above, last = stack.pop()
            term = self.term[at]
            if term is not None and depth >= least and row[n] <= k and (best is None or (row[n], term) < best):
                best = (row[n], term)
            for c, nxt in self.next[at].items():
                new = [row[0] + 1]
                for i in range(n):
                    d = min(new[i] + 1, row[i + 1] + 1, row[i] + (word[i] != c))
                    if above is not None and i and word[i] == last and word[i - 1] == c:
                        d = min(d, above[i - 1] + 1)
                    new.append(d)
                if min(new) <= k:
                    stack.append((nxt, depth + 1, new, row, c))
        return best[1] if best else None


class Lexicon:
    def __init__(self, terms: list[str], stems: dict[str, float], ordinary: list[str], near: dict[str, float] | None = None):
        #: stems: with the weight of a hit; ordinary: words one edit from a term that clean labelled documents have
        #: near: what a word one edit from a term weighs, NEAR if it isn't said
        self.terms, self.stems, self.ordinary, self.near = sorted(terms), dict(sorted(stems.items())), set(ordinary), near or {}

    def build(self) -> Trie:
        """The terms; automata walk only these, stems have a trie of their own."""
        trie = Trie()
        for t in self.terms:
            trie.add(t)
        return trie

    def build_stems(self) -> Trie:
        trie = Trie()
        for s in self.stems:
            trie.add(s, stem=True)
        return trie


class Finder:
    """Words of a block that may match, found by the hashes of their heads and tails, then checked on the trie.

    Of a word one edit from a term, the term's first half starts it or the second half ends it, or the two letters
    where the halves meet are swapped.
    """

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.trie, self.stems, self.known = lexicon, lexicon.build(), lexicon.build_stems(), {}
        heads: dict[int, set[bytes]] = {}
        tails: dict[int, set[bytes]] = {}
        for t in lexicon.terms:
            if len(t) >= FUZZY_LENGTH:
                a, b = t[: len(t) // 2].encode(), t[len(t) // 2 :].encode()
                heads.setdefault(len(a), set()).add(a)
                half = len(t) // 2
                swapped = (t[: half - 1] + t[half] + t[half - 1]).encode()
                heads.setdefault(len(swapped), set()).add(swapped)
                tails.setdefault(len(b), set()).add(b)
            else:
                heads.setdefault(len(t.encode()), set()).add(t.encode())
        for s in lexicon.stems:
            heads.setdefault(len(s.encode()), set()).add(s.encode())
        self.heads = {n: self._hashes(x) for n, x in heads.items()}
        self.tails = {n: self._hashes(x) for n, x in tails.items()}

    @staticmethod
    def _hashes(parts: set[bytes]) -> np.ndarray:
        block = block_of(pa.array(sorted(p.decode("utf-8") for p in parts)))
        return np.sort(span_hash(block.prefix_hash(), block.offsets[:-1], block.offsets[1:]))

    def check(self, word: str) -> tuple[str, float] | None:
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            term, weight = self.trie.exact(word), EXACT
            if term is None and (term := self.stems.exact(word)) is not None:
                weight = self.lexicon.stems[term]
            if term is None and len(word) >= FUZZY_LENGTH - 1 and word not in self.lexicon.ordinary:
                term = self.trie.near(word)
                weight = self.lexicon.near.get(term, NEAR)
            self.known[word] = (term, weight) if term is not None else None
        return self.known[word]

    def hits(self, block: Block) -> list[tuple[int, int, int, str, float]]:
        """text, word number in the text, word number in the block, term, weight."""
        starts, ends, bounds = block.words()
        if not len(starts):
            return []
        prefix = block.prefix_hash()
        may = np.zeros(len(starts), dtype=bool)
        size = ends - starts
        for table_, tail in ((self.heads, False), (self.tails, True)):
            for n, known in table_.items():
                at = np.flatnonzero(size >= n)
                h = span_hash(prefix, ends[at] - n, ends[at]) if tail else span_hash(prefix, starts[at], starts[at] + n)
                spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                may[at[known[spot] == h]] = True
        out = []
        folded = block.folded
        for w in np.flatnonzero(may):
            if found := self.check(folded[starts[w] : ends[w]].tobytes().decode("utf-8", "replace")):
                text = int(np.searchsorted(bounds, w, side="right")) - 1
                out.append((text, int(w - bounds[text]), int(w), *found))
        return out


_QUOTES = ('"', "“", "”", "«", "»", "„")


def quoted(block: Block, text: int, word: int) -> bool:
    """Whether an odd number of quotation marks stands before the word on its line and another after it, or reporting words just before."""
    starts, ends, bounds = block.words()
    lo, hi = block.offsets[text], block.offsets[text + 1]
    begin, end = starts[word], ends[word]
    before = block.data[lo:begin].tobytes().rpartition(b"\n")[2].decode("utf-8", "replace")
    after = block.data[end:hi].tobytes().partition(b"\n")[0].decode("utf-8", "replace")
    marks = sum(before.count(q) for q in _QUOTES)
    if marks % 2 and any(q in after for q in _QUOTES):
        return True
    folded = block.folded
    return any(folded[starts[w] : ends[w]].tobytes().decode("utf-8", "replace") in REPORTING for w in range(max(bounds[text], word - 4), word))


def score_text(block: Block, hits: list[tuple[int, int, int, str, float]]) -> tuple[float, int, list[str]]:
    """Score, quoted hits and terms of one text's hits."""
    total, inside = 0.0, 0
    for k, (text, at, word, _, weight) in enumerate(hits):
        if quoted(block, text, word):
            total += weight * QUOTED
            inside += 1
            continue
        beside = any(abs(hits[j][1] - at) <= WINDOW for j in (k - 1, k + 1) if 0 <= j < len(hits))
        total += weight + TOGETHER * beside
    return total, inside, sorted({h[3] for h in hits})


def _copies(words: list[set[str]], least: int = 8, share: float = 0.3) -> list[int]:
    """A number for each document, the same for copies: of least telling words or more, they share so many of all."""
    of: list[int] = []
    holders: dict[str, list[int]] = {}
    for k, own in enumerate(words):
        same = k
        if len(own) >= least:
            met: dict[int, int] = {}
            for w in own:
                for other in holders.get(w, ()):
                    met[other] = met.get(other, 0) + 1
            close = [o for o, n in met.items() if n >= least // 2 and n >= share * (len(own) + len(words[o]) - n)]
            if close:
                same = of[min(close)]
            for w in own:
                holders.setdefault(w, []).append(k)
        of.append(same)
    return of


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, clean_share: float = 0.02, lift: float = 10.0, seed: int = 5) -> Lexicon:
    """Learn the lexicon on at most fit_rows labelled documents (lowest hash of doc_id first).

    A term occurs in at most clean_share as many clean documents as toxic ones.  A stem is a head that
    several words share which toxic documents have ``lift`` times as often as clean ones; where a stem
    isn't as pure as a term, its hits weigh half.  Both are picked greedily by toxic documents not yet
    explained; copies of one document count once, so the words that only they share add nothing.  Then terms as frequent as a
    fifth of the picked ones' median are added.  Words of fewer than three bytes are no terms.
    """
    picked = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("_toxic")).where("doc_id is not null and _toxic is not null").groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(fit_rows)
    )
    with scratch(docs.sparkSession):
        return _fit(docs, picked, clean_share, lift)


def _fit(docs: DataFrame, picked: DataFrame, clean_share: float, lift: float) -> Lexicon:
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")  # fit_rows at most

    def vocabulary(batches):
        for b in batches:
            toxic = b.column(2).to_pylist()
            for block in blocks(b.column(1)):
                starts, ends, bounds = block.words()
                hashes = block.word_hashes()
                folded = block.folded.tobytes()
                at, kind, words = [], [], []
                for i in range(len(block)):
                    _, first = np.unique(hashes[bounds[i] : bounds[i + 1]], return_index=True)
                    first += bounds[i]
                    own = [folded[x:y].decode("utf-8", "replace") for x, y in zip(starts[first].tolist(), ends[first].tolist()) if y - x >= 3]
                    words += own
                    at += [block.first + i] * len(own)
                    kind += [toxic[block.first + i]] * len(own)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, type=pa.int64())), pa.array(words, type=pa.string()), pa.array(kind, type=pa.int32())], names=["doc_id", "word", "toxic"])

    seen = cut(rows.mapInArrow(vocabulary, "doc_id long, word string, toxic int").where("not word rlike '[0-9]'"))
    totals = {bool(r["bad"]): r["n"] for r in seen.groupBy((F.col("toxic") > 0).alias("bad")).agg(F.countDistinct("doc_id").alias("n")).collect()}
    if not totals.get(True):
        return Lexicon([], {}, [])
    odds = lift * totals[True] / max(1, totals.get(False, 0))
    counts = cut(seen.groupBy("word").agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") > 0, 0).otherwise(1)).alias("good")))
    able = counts.where((F.col("bad") >= 2) & (F.col("good") * odds <= F.col("bad")))
    has = seen.where("toxic > 0").join(beside(able), "word").groupBy("doc_id").agg(F.collect_set("word").alias("words")).toPandas()
    pure = {r["word"] for r in able.where(F.col("good") <= F.col("bad") * clean_share).select("word").collect()}
    docs_of: dict[str, set[int]] = {}
    copies = _copies([set(words) for words in has["words"]])
    for k, words in zip(copies, has["words"]):
        for w in words:
            docs_of.setdefault(w, set()).add(k)
    family: dict[str, set[str]] = {}
    for w in docs_of:
        for n in range(_STEM, len(w) + 1):
            family.setdefault(w[:n], set()).add(w)
    stems = {s: set().union(*(docs_of[w] for w in ws)) for s, ws in family.items() if len(ws) >= 4}
    weights: dict[str, float] = {}
    if stems:
        sizes = sorted({len(s) for s in stems})
        mine = docs.sparkSession.createDataFrame([(s,) for s in stems], "stem string")
        heads = counts.where("good > 0").select("good", F.explode(F.array_distinct(F.array(*[F.substring("word", 1, n) for n in sizes]))).alias("stem"))
        good = {r["stem"]: r["good"] for r in heads.join(beside(mine), "stem").groupBy("stem").agg(F.sum("good").alias("good")).collect()}
        stems = {s: d for s, d in stems.items() if good.get(s, 0) * odds <= len(d)}
        weights = {s: EXACT if good.get(s, 0) <= len(d) * clean_share else NEAR for s, d in stems.items()}
    candidates = {(w, False): d for w, d in docs_of.items() if w in pure} | {(s, True): d for s, d in stems.items()}
    chosen, left = [], set(copies)
    least = max(5, len(left) // 100)
    while candidates:
        key = max(candidates, key=lambda c: (len(candidates[c] & left), len(candidates[c]), len(c[0]), c))
        if len(candidates[key] & left) < least:
            break
        chosen.append((key, len(candidates[key])))
        left -= candidates.pop(key)
    if not chosen:
        return Lexicon([], {}, [])
    floor = max(5.0, float(np.median([n for _, n in chosen])) / 5)
    names = {k for k, _ in chosen} | {k for k, d in candidates.items() if len(d) >= floor}
    tops = [s for s, stem in names if stem]
    tops = [s for s in tops if not any(s != o and s.startswith(o) for o in tops)]
    terms = sorted(w for w, stem in names if not stem and not any(w.startswith(s) for s in tops))
    lexicon = Lexicon(terms, {s: weights[s] for s in tops}, [])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def neighbours(batches):
        trie = shared.value.build()
        for b in batches:
            own = [(w, t, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if trie.exact(w) is None and (t := trie.near(w))]
            cols = list(zip(*own)) if own else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.string()), pa.array(cols[1], type=pa.string()), pa.array(cols[2], type=pa.int64())], names=["word", "term", "good"])

    near = counts.where((F.col("good") > 0) & F.length("word").between(FUZZY_LENGTH - 1, max(map(len, terms), default=0) + 1)).select("word", "good").mapInArrow(neighbours, "word string, term string, good long")
    rows = near.collect() if terms else []
    beset = {r["term"] for r in rows}
    weight = {t: NEAR if t in beset else EXACT for t in terms}
    return Lexicon(terms, lexicon.stems, [r["word"] for r in rows], weight)


def find_toxic(docs: DataFrame, lexicon: Lexicon, cut_at: float = CUT) -> DataFrame:
    """The toxic documents: doc_id, score, hits, how many of them were quoted, and the terms.

    Null and empty texts aren't toxic; rows that repeat are reported each; an empty lexicon finds nothing; a score of
    cut_at itself is toxic.  Of terms equally near to a word the first by name counts.  Other columns of docs aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def find(batches):
        finder = Finder(shared.value) if shared.value.terms or shared.value.stems else None
        for b in batches:
            at, rows = [], []
            for block in blocks(b.column(1)) if finder else ():
                by_text: dict[int, list] = {}
                for hit in finder.hits(block):
                    by_text.setdefault(hit[0], []).append(hit)
                for text, hits in by_text.items():
                    score, inside, terms = score_text(block, hits)
                    if score >= cut_at:
                        at.append(block.first + text)
                        rows.append((score, len(hits), inside, terms))
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, type=pa.int64())), *[pa.array(c, type=t) for c, t in zip(cols, kinds)]], names=["doc_id", "score", "hits", "quoted_hits", "terms"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").mapInArrow(find, "doc_id long, score double, hits int, quoted_hits int, terms array<string>")


def op7_toxic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic ones of all documents, by a lexicon of the labelled ones; rows as find_toxic says."""
    docs = table(spark, sf_dir, "documents")
    return find_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))
