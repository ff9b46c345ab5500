"""The other operators against brute force, round trips and held-out labels."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, langid, licenses, packing, quality, repair, toxicity, urlfilter
from lodestar.llm.blocks import block_of

WORDS = re.compile(r"[^\W_]+")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# Quality rules

def test_forest_held_out(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, marks.where("doc_id % 2 = 0"))
    got = quality.score_documents(docs, model).join(marks.where("doc_id % 2 = 1"), "doc_id").select("quality", "keep").collect()
    good = [r["keep"] for r in got if r["quality"] == 1]
    bad = [r["keep"] for r in got if r["quality"] == 0]
    assert len(bad) >= 10 and np.mean(good) >= 0.97 and np.mean(bad) <= 0.2


def test_forest_paths():
    r = np.random.default_rng(1)
    x = np.concatenate((r.normal(size=(500, 2)), [[9, 9]]))
    forest = quality.Forest().fit(x)
    assert forest.score(x).argmax() == 500
    slow = []
    for row in x[::50]:
        total = 0.0
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] < forest.split[node] else forest.right[node]
            total += forest.path[node]
        slow.append(2 ** -(total / len(forest.roots) / forest.norm))
    assert np.allclose(slow, forest.score(x[::50]))


def test_quality_fits_on_all_labels(spark, make):
    """Quantiles are those of all rows; a language whose rows have the highest hashes has its own cut, however many others there are."""
    r = np.random.default_rng(3)
    values = np.concatenate([r.random(5000), np.zeros(300), r.random(200) * 1e-9])
    got = quality.ranked(spark.createDataFrame([("a", float(x)) for x in values] + [("b", 2.5)], "key string, value double"), {"a": [0, 299, 3000, 5499], "b": [0]})
    assert got == {"a": [float(np.sort(values)[k]) for k in (0, 299, 3000, 5499)], "b": [2.5]}
    n = 24_000
    docs = spark.range(n).selectExpr("id doc_id", "'a few plain words number ' || case when id % 9 = 0 then '|||| #### $$$$ |||| ' || id else 'of prose' end text", "'l' || id % 2 lang")
    order = [x[0] for x in docs.selectExpr("doc_id", "xxhash64(doc_id, 7) h").orderBy("h").select("doc_id").collect()]
    last = spark.createDataFrame([(x,) for x in order[20_000:]], "doc_id long")
    docs = docs.join(last.selectExpr("doc_id", "'rare' other"), "doc_id", "left").selectExpr("doc_id", "text", "coalesce(other, lang) lang")
    model = quality.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 9 <> 0) quality"))
    assert set(model.by_lang) == {"l0", "l1", "rare"}


def test_quality_odd(spark, make, odd):
    docs = make([*odd, *[(100 + i, f"plain words of number {i} go here and there") for i in range(40)], *[(200 + i, "### $$$ %%% AAA ### $$$ BBB") for i in range(40)]], clash=True)
    marks = labels(spark, [(100 + i, 1, 0) for i in range(40)] + [(200 + i, 0, 0) for i in range(40)] + [(None, 1, 0), (100, None, 0)])
    model = quality.fit(docs, marks)
    got = {}
    for r in quality.score_documents(docs, model).collect():
        got.setdefault(r["doc_id"], []).append(r["keep"])
    assert all(all(got[i]) for i in (1, 2, 3, 5, 7)) and len(got[5]) == 2 and all(all(got[100 + i]) for i in range(40)) and not any(any(got[200 + i]) for i in range(40))
    assert docs.where(quality.keep_column(spark, model)).columns == docs.columns
    assert all(r["keep"] for r in quality.score_documents(docs, quality.fit(docs, marks.limit(0))).collect())
    assert quality.score_documents(make([]), model).count() == 0


# Packing

def slow_pack(lengths, capacity):
    left = sorted(lengths)
    bins = []
    while left:
        own, room = [], capacity
        while fit := [x for x in left if x <= room]:
            own.append(max(fit))
            left.remove(max(fit))
            room -= own[-1]
        if room:
            small = own[-1]
            best = None
            for i, x in enumerate(left):
                for y in left[i + 1 :]:
                    if small < x + y <= room + small and (best is None or x + y > best[0] or x + y == best[0] and min(x, y) < best[1]):
                        best = (x + y, min(x, y))
            if best:
                own.pop()
                for x in (best[0] - best[1], best[1]):
                    own.append(x)
                    left.remove(x)
                left.append(small)
                left.sort()
        bins.append(sorted(own))
    return sorted(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_packing_same_as_brute_force(lengths):
    lengths = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    bin_of, place, start = packing.pack(lengths, 30)
    bins = {}
    for b, p, s, n in zip(bin_of, place, start, lengths):
        bins.setdefault(b, []).append((p, s, n))
    for own in bins.values():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own))) and all(s == sum(x[2] for x in own[:k]) for k, (_, s, _) in enumerate(own)) and sum(x[2] for x in own) <= 30
    assert sorted(sorted(int(x[2]) for x in own) for own in bins.values()) == slow_pack(lengths.tolist(), 30)


def test_packing_rows(make, odd):
    rows = packing.pack_documents(make(odd, clash=True), capacity=50).collect()
    want = {}
    for i, t in odd:
        want[i] = want.get(i, 0) + len((t or "").split())
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["words"]
    assert got == {i: n for i, n in want.items() if n} and max(r["words"] for r in rows) == 50
    bins = {}
    for r in rows:
        bins.setdefault((r["shard"], r["bin"]), []).append(r["words"])
    assert None not in {x for b in bins for x in b} and all(sum(x) <= 50 for x in bins.values()) and all(len(x) == 1 for x in bins.values() if 50 in x)
    assert packing.pack_documents(make([])).count() == 0


# Licenses

def test_licenses(make, odd):
    mit = licenses._MIT
    broken = mit.replace("without limitation", "with no limit at all").replace("merge,", "")
    rows = [*odd, (20, "intro words " * 30 + mit), (21, broken + " and more"), (22, " ".join(mit.split()[::-1])), (23, "code\nLicensed under CC BY 4.0.\nmore"), (24, "the rights to use copy modify")]
    got = licenses.scan(make([*rows, rows[10]], clash=True)).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(20, "MIT"), (21, "MIT"), (23, "CC-BY-4.0")}
    assert [r["word_start"] for r in got if r["doc_id"] == 20] == [60] and all(r["similarity"] == 1 for r in got if r["doc_id"] in (20, 23))
    assert licenses.scan(make([])).count() == 0


def slow_scan(rows, templates, k=licenses.K, similarity=0.8, least_words=8):
    """scan, text by text."""
    out = set()
    words = lambda t: WORDS.findall(t.lower())
    number = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws])
    for i, t in rows:
        if i is None or not t:
            continue
        own, here = words(t), []
        for no, (name, template) in enumerate(templates):
            tw = words(template)
            by = {}
            for a in range(len(tw) - k + 1):
                for p in range(len(own) - k + 1):
                    if own[p : p + k] == tw[a : a + k]:
                        by.setdefault(p - a, []).append((p, a))
            hoods = []
            for d in sorted(by):
                if hoods and d - hoods[-1][-1] <= licenses.DRIFT:
                    hoods[-1].append(d)
                else:
                    hoods.append([d])
            for hood in hoods:
                rows_ = sorted((min(p for p, _ in by[d]), max(p for p, _ in by[d]) + k, d) for d in hood)
                parts, top = [], 0
                for lo, hi, d in rows_:
                    if not parts or lo - top > licenses.GAP:
                        parts.append([])
                        top = hi
                    parts[-1].append((len(by[d]), lo, hi, min(a for _, a in by[d]), max(a for _, a in by[d]) + k))
                    top = max(top, hi)
                for part in parts:
                    least = min(least_words, len(tw)) if len(tw) > k else len(tw)
                    got = licenses.best_span(code(own), code(tw), part, similarity, least)
                    if got:
                        here.append((no, *got))
        out |= {(i, templates[p[0]][0], *p) for p in licenses.outermost(here)}
    return out


def test_licenses_same_as_brute_force(make, odd):
    r = random.Random(14)
    templates = [t for t in licenses.TEMPLATES if t[0] in ("MIT", "ISC", "CC-BY-4.0")]
    plain = "of the software and this is a copy to any person without fee by some author for every purpose".split()
    rows, planted = [*odd[:8]], {}
    for i in range(40):
        name, t = templates[i % len(templates)]
        w = t.split()
        for _ in range(len(w) // 25):
            at = r.randrange(len(w))
            r.choice([lambda: w.pop(at), lambda: w.insert(at, "zzz"), lambda: w.__setitem__(at, "yyy")])()
        rows.append((100 + i, " ".join([r.choice(plain) for _ in range(r.randint(0, 40))] + w + [r.choice(plain) for _ in range(r.randint(0, 40))])))
        planted[100 + i] = i % len(templates)
    got = [tuple(x[c] for c in ("doc_id", "license", "template", "word_start", "word_end", "coverage", "similarity")) for x in licenses.scan(make(rows, clash=True), templates).collect()]
    assert len(got) == len(set(got)) and set(got) == slow_scan(rows, templates)
    for i, no in planted.items():
        own = [x for x in got if x[0] == i and x[2] == no]
        assert len(own) == 1 and own[0][5] > 0.85


def test_one_row_for_a_license_less_a_word(make):
    words = licenses._MIT.split()
    rows = [(i, "some code\n" + " ".join(words[:at] + words[at + 1 :])) for i, at in enumerate((10, 40, 66, 100, 130))]
    got = [x for x in licenses.scan(make(rows)).collect() if x["template"] == 0]
    assert sorted(x["doc_id"] for x in got) == [0, 1, 2, 3, 4] and all(x["coverage"] > 0.97 for x in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    assert licenses.edit_distance(np.array(a), np.array(b)) == row[-1]


# Decontamination

def sellers(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        before, row[0] = row[0], 0
        for j, p in enumerate(pattern, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != c))
        best = min(best, row[-1])
    return best


def test_leaks_same_as_brute_force(spark, make, odd):
    r = random.Random(3)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(6, 30)))) for i in range(8)] + [(90, None), (91, ""), (92, "too short"), (93, "a dozen char"), (94, "?!"), (None, "alpha beta gamma delta omega sigma")]
    rows = list(odd)
    for i in range(40):
        text = list(r.choice(items[:8])[1])
        for _ in range(r.choice([0, 1, 2, 5, 9])):
            at = r.randrange(len(text))
            r.choice([lambda: text.__setitem__(at, "x"), lambda: text.pop(at), lambda: text.insert(at, "y")])()
        rows.append((100 + i, "Some words, before. " * r.randint(0, 3) + "".join(text).upper() + "\n after"))
    rows += [(200, "It had a dozen char, no more"), (201, "It had a dozen chars"), (202, "too  SHORT!"), (203, "too shorts")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make(rows, clash=True)
    norm = lambda t: " ".join(WORDS.findall(t.lower()))
    want = set()
    for i, t in rows:
        if t and len(t) < 5000:
            for item, p in items:
                if item is not None and p and norm(p) and sellers(f" {norm(p)} ", f" {norm(t)} ") <= int(len(norm(p)) * decontaminate.ERROR_RATE):
                    want.add((i, item))
    assert len(want) > 20 and {(200, 93), (202, 92)} <= want and not {201, 203} & {i for i, _ in want}
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, benchmark).collect()} == want
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, benchmark, part_bytes=60).collect()} == want
    left = decontaminate.clean_documents(docs, benchmark)
    assert left.columns == docs.columns and {str(x["doc_id"]) for x in left.collect()} == {str(i) for i, _ in rows} - {str(i) for i, _ in want}
    assert decontaminate.find_leaks(make([]), benchmark).count() == 0 and decontaminate.find_leaks(docs, benchmark.limit(0)).count() == 0


# Toxicity

def swaps(a, b):
    """Edit distance in which a swap of neighbours is one edit."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def slow_toxic(text, lexicon):
    """Score and terms of a text, word by word."""
    found = []
    words = [(m.start(), m.end(), m.group().lower()) for m in WORDS.finditer(text or "")]
    for n, (a, z, w) in enumerate(words):
        hit = (w, 1.0) if w in lexicon.terms else max(((s, x) for s, x in lexicon.stems.items() if w.startswith(s)), key=lambda y: len(y[0]), default=None)
        if hit is None and len(w) >= toxicity.FUZZY_LENGTH - 1 and w not in lexicon.ordinary:
            near = min(((swaps(t, w), t) for t in lexicon.terms if len(t) >= toxicity.FUZZY_LENGTH), default=(9, None))
            hit = (near[1], lexicon.near.get(near[1], toxicity.NEAR)) if near[0] <= 1 else None
        if hit:
            before, after = text[:a].rpartition("\n")[2], text[z:].partition("\n")[0]
            quoted = sum(before.count(q) for q in '"“”«»„') % 2 == 1 and any(q in after for q in '"“”«»„')
            found.append((n, *hit, quoted or any(x in toxicity.REPORTING for _, _, x in words[max(0, n - 4) : n])))
    total = 0.0
    for k, (n, _, weight, quoted) in enumerate(found):
        beside = any(abs(found[j][0] - n) <= toxicity.WINDOW for j in (k - 1, k + 1) if 0 <= j < len(found))
        total += weight * toxicity.QUOTED if quoted else weight + toxicity.TOGETHER * beside
    return total, sorted({h[1] for h in found})


def test_toxic_same_as_brute_force(make, odd):
    r = random.Random(12)
    lexicon = toxicity.Lexicon(["stupid", "pathetic", "moron", "scum"], {"idio": 1.0, "hatef": 0.5}, ["moran"], {"pathetic": 1.0})
    words = ["stupid", "stuipd", "sutpid", "stupd", "pathetic", "pathteic", "patheticc", "moron", "moran", "oron", "scum", "scam", "idiotic", "hateful", "said", "plain", "words", "Stupid,", '"stupid"', '"', "\n", "the", "x" * 90]
    rows = [*odd[:8], *[(100 + i, " ".join(r.choice(words if r.random() < 0.25 else ["plain", "words", "go", "here"]) for _ in range(r.randint(1, 40)))) for i in range(300)]]
    want = {}
    for i, t in rows:
        score, terms = slow_toxic(t, lexicon)
        if score >= toxicity.CUT:
            want[i] = (score, terms)
    got = {x["doc_id"]: (x["score"], x["terms"]) for x in toxicity.find_toxic(make(rows, clash=True), lexicon).collect()}
    assert len(want) > 60 and got == want


def test_one_misspelled_term(spark, make):
    """A single misspelled term, or one with two letters swapped, is found if clean documents have no words like it."""
    rows = [(i, f"you are pathetic and number {i} of us") for i in range(40)] + [(100 + i, f"a word of number {i} goes here and there") for i in range(80)]
    docs = make(rows)
    lexicon = toxicity.fit(docs, labels(spark, [(i, 1, int(i < 100)) for i, _ in rows]))
    assert "pathetic" in lexicon.terms
    got = {x["doc_id"] for x in toxicity.find_toxic(make([(1, "what a pathetc thing"), (2, "what a pahtetic thing"), (3, "what a thing"), (4, "they said pathetc")]), lexicon).collect()}
    assert got == {1, 2}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc", min_size=5, max_size=7), min_size=1, max_size=6), st.text("abc", min_size=4, max_size=8))
def test_automaton(terms, word):
    trie = toxicity.Trie()
    for t in terms:
        trie.add(t)

    want = min(((swaps(t, word), t) for t in terms), default=(9, None))
    assert trie.near(word) == (want[1] if want[0] <= 1 else None)


def test_toxic_context(make, odd):
    lexicon = toxicity.Lexicon(["stupid", "pathetic"], {}, [])
    rows = [*odd, (20, "you are stupid and pathetic"), (21, 'they said "stupid" once'), (22, "what a stupyd, patetic thing"), (23, "he called it pathetic"), (24, "nothing here"), (25, "STUPID")]
    got = {r["doc_id"]: r for r in toxicity.find_toxic(make(rows, clash=True), lexicon).collect()}
    assert set(got) == {20, 22, 25} and got[22]["terms"] == ["pathetic", "stupid"] and got[20]["score"] == 2.5
    assert toxicity.find_toxic(make(rows), toxicity.Lexicon([], {}, [])).count() == 0 and toxicity.find_toxic(make([]), lexicon).count() == 0


def test_toxicity_held_out(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.1")
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    lexicon = toxicity.fit(docs, marks.where("doc_id % 2 = 0"))
    found = toxicity.find_toxic(docs, lexicon).select("doc_id", F.lit(1).alias("hit"))
    got = docs.select("doc_id").join(marks.where("doc_id % 2 = 1"), "doc_id").join(found, "doc_id", "left").select("toxic", "hit").collect()
    assert np.mean([r["hit"] == 1 for r in got if r["toxic"] == 1]) >= 0.8 and np.mean([r["hit"] == 1 for r in got if r["toxic"] == 0]) <= 0.005
    assert toxicity.fit(docs, marks.where("toxic = 0")).terms == []


# Re-Pair

@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=5), st.data())
def test_grammar_round_trip(texts, data):
    flat = np.array([x for t in texts for x in t], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    symbols, starts, rules = repair.compress(flat.copy(), bounds, 4, least=2)
    lengths = repair.expansion_lengths(rules, 4)
    assert len(symbols) <= len(flat)
    for k, t in enumerate(texts):
        own = symbols[starts[k] : starts[k + 1]]
        assert repair.decode(own, rules, lengths, 4) == t
        a = data.draw(st.integers(0, len(t)))
        n = data.draw(st.integers(0, len(t)))
        assert repair.decode(own, rules, lengths, 4, a, n) == t[a : a + n]


def slow_pairs(texts, least):
    """Re-Pair as it is written: the most frequent pair, again and again.  Symbols left and rules."""
    texts, rules, new = [list(t) for t in texts], 0, 10**6
    while True:
        count = {}
        for t in texts:
            i = 0
            last = {}
            for i in range(len(t) - 1):
                p = (t[i], t[i + 1])
                if last.get(p) != i - 1:
                    count[p] = count.get(p, 0) + 1
                    last[p] = i
        if not count or max(count.values()) < least:
            return sum(map(len, texts)), rules
        best = max(count, key=lambda p: (count[p], p))
        for t in texts:
            i = 0
            while i < len(t) - 1:
                if (t[i], t[i + 1]) == best:
                    t[i : i + 2] = [new]
                i += 1
        new, rules = new + 1, rules + 1


def test_grammar_near_the_greedy_one():
    """As small as most-frequent-first within a tenth, and nothing left that pays for a rule."""
    r = random.Random(6)
    phrases = [[r.randrange(40) for _ in range(r.randint(3, 12))] for _ in range(25)]
    texts = [[x for _ in range(r.randint(0, 40)) for x in (r.choice(phrases) if r.random() < 0.8 else [r.randrange(40)] * r.randint(1, 5))] for _ in range(30)]
    flat, bounds = np.array([x for t in texts for x in t], dtype=np.int64), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    symbols, starts, rules = repair.compress(flat, bounds, 40)
    left, made = slow_pairs(texts, repair.LEAST_COUNT)
    assert len(symbols) + 3 * len(rules) <= 1.1 * (left + 3 * made)
    count = {}
    for a, z in zip(starts[:-1], starts[1:]):
        last = {}
        for i in range(a, z - 1):
            p = (int(symbols[i]), int(symbols[i + 1]))
            if last.get(p) != i - 1:
                count[p] = count.get(p, 0) + 1
                last[p] = i
    assert max(count.values()) < repair.LEAST_COUNT


def test_grammar_sorts_few_pairs(monkeypatch):
    """Pairs that are surely too rare for a rule aren't sorted (F1)."""
    r = np.random.default_rng(8)
    flat = r.integers(0, 50_000, 60_000)
    flat[::100], flat[1::100] = 7, 9
    given_to, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda x, *a, **k: (given_to.append(len(x)), unique(x, *a, **k))[1])
    symbols, _, rules = repair.compress(flat, np.array([0, len(flat)]), 50_000)
    assert [7, 9] in rules.tolist() and len(symbols) <= len(flat) - 600
    assert sum(given_to) < len(flat) / 10
    assert repair.decode(symbols, rules, repair.expansion_lengths(rules, 50_000), 50_000) == flat.tolist()


def test_encoder_looks_for_a_special_token():
    """Without one tiktoken looks at every character apart (F1); its text is ordinary all the same, and so are its ids."""
    enc = repair.encoder(repair.VOCABULARY)
    assert enc.special_tokens_set
    texts = ["<|endoftext|>", "a<|endoftext|> b\n\n<|endoftext|", "", None, "  \t x\u00a0\u4e2d\U0001f600 it's <|<|endoftext|>|>  "]
    got = repair.tokens(pa.array(texts), enc)
    assert [x.tolist() for x in got] == [enc.encode_ordinary(x) if x else [] for x in texts]
    assert max(int(x.max()) for x in got if len(x)) < enc.max_token_value and enc.decode(got[1].tolist()) == texts[1]


def test_shards_round_trip(make, odd):
    rows = [*odd, *[(100 + i, f"the same sentence again and again, number {i % 7}. " * 20) for i in range(60)]]
    shards = repair.write_shards(make(rows, clash=True), shard_tokens=3000)
    got = sorted(((r["doc_id"], tuple(r["tokens"])) for r in repair.read_documents(shards).collect()), key=repr)
    enc = repair.encoder(repair.VOCABULARY)
    assert got == sorted(((i, tuple(enc.encode_ordinary(t)) if t else ()) for i, t in rows), key=repr)
    assert repair.write_shards(make([])).count() == 0


# URL filter

def slow_url(url, entries):
    if not url:
        return ("allow", 0, 0)
    rest = re.sub(r"[?#][\s\S]*$", "", re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*://", "", url))
    host, _, path = rest.partition("/")
    labels = [x for x in reversed(re.sub(r":[0-9]*$", "", re.sub(r"^[^@]*@", "", host)).lower().split(".")) if x]
    path = [x for x in path.split("/") if x]
    best = (0, 0, "allow")
    for kind, e in entries:
        l, p = urlfilter.entry_key(e)
        if labels[: len(l)] == l and path[: len(p)] == p:
            best = max(best, (len(l), len(p), kind))
    return (best[2], best[0], best[1])


def test_urls(spark):
    hosts = ["example.org", "a.example.org", "spam-farm.example.org", "M.example.com", "example.net", "blog.example.net", "org", ""]
    r = random.Random(1)
    urls = [f"{r.choice(['http://', 'https://', '', 'http://u:p@'])}{r.choice(hosts)}{r.choice(['', ':80'])}{r.choice(['', '/', '/fr', '/es/x', '/de/9', '//de/1?q=/x', '#f'])}" for _ in range(150)] + [None, "", "/", "?", "http://", "http://example.org/" + "a/" * 5000, "http://" + "x." * 3000 + "example.net/es", "http://example.net/es", "http://example.net/es"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("decision", F.lit("x")).withColumn("labels", F.lit(1))
    want = {i: slow_url(u, urlfilter.ENTRIES) for i, u in enumerate(urls)}
    for limit in (10**6, 0):
        got = {x["page_id"]: (x["decision"], x["labels"], x["segments"]) for x in urlfilter.decide(pages, urlfilter.ENTRIES, trie_entries=limit).collect()}
        assert got == want
    assert urlfilter.decide(pages.limit(0), urlfilter.ENTRIES).count() == 0 and {x["decision"] for x in urlfilter.decide(pages, []).collect()} == {"allow"}


# Languages

@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.lists(st.integers(0, 130), min_size=1, max_size=4), st.integers(1, 4), st.sampled_from([0.0, 1.0, 12.0]))
def test_viterbi_same_as_plain(seed, sizes, langs, penalty):
    r = np.random.default_rng(seed)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    scores = r.normal(size=(int(bounds[-1]), langs)).astype(np.float32)
    got = langid.viterbi(scores, bounds, penalty)
    for a, z in zip(bounds[:-1], bounds[1:]):
        value = None
        for row in scores[a:z]:
            value = row.copy() if value is None else np.maximum(value, value.max() - penalty) + row
        if z > a:
            path = got[a:z]
            total = scores[np.arange(a, z), path].sum() - penalty * (path[1:] != path[:-1]).sum()
            assert np.isclose(total, value.max(), atol=1e-2)


def test_languages(spark, sf_dir, make, odd):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    test = docs.where("doc_id % 2 = 1")
    by = langid.label_spans(test, model).groupBy("doc_id", "span_lang").agg(F.sum("words").alias("w")).groupBy("doc_id").agg(F.max_by("span_lang", "w").alias("got"))
    rows = by.join(test, "doc_id").where("n_chars > 60").select("got", "lang").collect()
    assert np.mean([r["got"] == r["lang"] for r in rows]) >= 0.95
    some = {x["lang"]: x["text"] for x in test.where("n_chars > 900").select("lang", "text").collect()}
    a, b = some["en"][:400].rpartition(" ")[0], some["de"][:400].rpartition(" ")[0]
    mixed = make([*odd, (50, f"{a} {b}")], clash=True)
    spans = langid.label_spans(mixed, model).orderBy("doc_id", "span").collect()
    assert [x["span_lang"] for x in spans if x["doc_id"] == 50] == ["en", "de"]
    cut = next(x["byte_start"] for x in spans if x["doc_id"] == 50 and x["span"] == 1)
    assert abs(cut - len(a.encode())) < 40
    assert [x["span_lang"] for x in spans if x["doc_id"] in (1, 2, 3, 4)] == ["und"] * 4
    assert langid.label_spans(make([]), model).count() == 0 and langid.fit(make([])).langs == []


def test_scripts():
    one = {"latin": "Aé", "greek": "αλ", "cyrillic": "жд", "hebrew": "אב", "arabic": "عر", "devanagari": "हि", "thai": "ไท", "hangul": "한국", "kana": "かナ", "han": "汉字", "georgian": "ქა", "tamil": "தமி", "armenian": "հա"}
    block = block_of(pa.array(list(one.values()) + ["\U00020000x", "abc"]))
    names = list(langid.SCRIPTS)
    got = langid.word_scripts(block)
    bounds = block.words()[2]
    assert [names[got[a]] for a in bounds[:-1]] == [*one, "han", "latin"]
    for c in ("हि", "ไท", "한", "か", "汉"):
        assert names[int(langid.scripts_of(np.array([ord(c[0])]))[0])] == next(k for k, v in one.items() if c[0] in v or c in v)


def test_spans_same_as_plain(make, odd):
    """Spans of a small model against scores and Viterbi worked out word by word."""
    model = langid.fit(make([(i, t) for i, t in enumerate(["the cat and the dog are here now", "der Hund und die Katze sind da"] * 5)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")), penalty=3.0)
    r = random.Random(2)
    words = "the cat and dog are here now der Hund und die Katze sind da жук".split()
    rows = [*odd[:8], *[(100 + i, " ".join(r.choice(words) for _ in range(r.randint(1, 70)))) for i in range(30)]]

    def score(word):
        b = word.lower().encode()
        total = np.zeros(2)
        for i, c in enumerate(b):
            key = np.uint32(c + ((b[i - 1] if i else 32) << 8) + ((b[i - 2] if i > 1 else 32) << 16))
            key ^= key >> np.uint32(15)
            key = np.uint32(int(key) * 0x2C1B3C6D & 0xFFFFFFFF)
            key ^= key >> np.uint32(12)
            total += model.logs[int(key) & (langid.SLOTS - 1)]
        return np.zeros(2) if any(ord(c) > 0x3FF for c in word) else total

    got = {}
    for x in langid.label_spans(make(rows, clash=True), model).collect():
        got.setdefault(x["doc_id"], []).append(x)
    for i, t in rows:
        own = WORDS.findall(t or "")
        if i is None or i < 100:
            continue
        scores = [score(w) for w in own]
        value = scores[0].copy()
        for s in scores[1:]:
            value = np.maximum(value, value.max() - 3.0) + s
        path = [model.langs.index(x["span_lang"]) for x in sorted(got[i], key=lambda x: x["span"]) for _ in range(x["words"])]
        assert len(path) == len(own) and np.isclose(sum(s[p] for s, p in zip(scores, path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:])), value.max(), atol=0.05)


def test_blocks():
    block = block_of(pa.array(["ÄB c", "", None, "äb C—d"]))
    starts, ends, bounds = block.words()
    assert bounds.tolist() == [0, 2, 2, 2, 5]
    h = block.word_hashes()
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
