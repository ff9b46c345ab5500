import random
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import lines as L
from lodestar.llm.runs import components


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=20, max_size=40), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(0, 255)), max_size=5), st.integers(1, 3))
def test_bands(a, edits, k):
    b = bytearray(a)
    for kind, at, c in edits:
        at %= max(1, len(b))
        if kind == 0:
            b[at] = c
        elif kind == 1:
            del b[at]
        else:
            b.insert(at, c)
    assert L.close([a], [bytes(b)], k)[0] == (distance(a, bytes(b)) <= k)


def test_one_long_line_among_many():
    """Pairs that are verified side by side aren't all padded to a very long one."""
    r = random.Random(13)
    lines = [bytes(r.choices(b"abcdefgh ", k=r.randint(20, 60))) for _ in range(4000)] + [bytes(r.choices(b"abcdefgh ", k=30_000))]
    a, b = lines * 2, [x[:5] + b"z" + x[6:] for x in lines] + [x[:3] + b"zzz" + x[6:9] + x[10:] for x in lines]
    tracemalloc.start()
    got = L.close(a, b, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [True] * 4001 + [False] * 4001 and peak < 100 << 20


def within(x, y, k=L.EDITS):
    if x == y:
        return True
    k = min(k, min(len(x), len(y)) // L.EDIT_BYTES)
    return abs(len(x) - len(y)) <= k and k > 0 and distance(x, y) <= k


def brute(rows, k=L.EDITS):
    found = sorted({(i, n, line.strip(" \t\r").encode()) for i, t in rows if t and i is not None for n, line in enumerate(t.split("\n")) if line.strip(" \t\r")}, key=lambda x: x[:2])
    group = list(range(len(found)))
    for j in range(len(found)):
        for i in range(j):
            if group[i] != group[j] and within(found[i][2], found[j][2], k):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return {(*found[j][:2], *found[group[j]][:2]) for j in range(len(found)) if group[j] != j}


def sample(seed, n=40):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh ü") for _ in range(r.randint(20, 50))).strip() + "x" for _ in range(12)]
    out = []
    for i in range(n):
        own = []
        for _ in range(r.randint(0, 5)):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                at = r.randrange(len(line))
                r.choice([lambda: line.__setitem__(at, "z"), lambda: line.pop(at), lambda: line.insert(at, "q")])()
            own.append("".join(line))
        out.append((i, "\n".join(own)))
    return out


def found(df):
    return {(r["doc_id"], r["line_no"], r["keep_doc_id"], r["keep_line_no"]) for r in df.collect()}


def test_short_lines(make):
    """Lines of any length repeat if they are equal; from 10 bytes on one edit counts, from 20 on two."""
    rows = [(1, "ten bytes!\nab\nnineteen bytes here"), (2, "ab\nten bytes?\nab\nninetien byttes here"), (3, "ten bytes?!\nac\n \nab"), (4, "x\ny\nx")]
    got = found(L.repeated_lines(make(rows)))
    assert got == brute(rows) and {(2, 0, 1, 1), (2, 1, 1, 0), (2, 2, 1, 1), (3, 0, 1, 0), (4, 2, 4, 0)} <= got and (2, 3, 1, 2) not in got


def test_lines_that_differ_in_a_number(make, monkeypatch):
    """Many lines of one segment: connected families, and ids too far apart to be one line, as brute force has it."""
    monkeypatch.setattr(L, "ALL_PAIRS", 4)
    r = random.Random(8)
    family = [f"page {i} of a long report, as printed" for i in range(60)]
    apart = [f"user {r.randrange(10**9):09d} has logged in from home" for _ in range(60)]
    near = [x[:9] + "7" + x[10:] for x in apart[:10]]
    short = [f"item {r.randrange(10**6)}." for _ in range(50)]
    rows = [(i, x) for i, x in enumerate(r.sample(family + apart + near + short, 180))]
    want = brute(rows)
    assert len(want) > 60 and found(L.repeated_lines(make(rows))) == want
    monkeypatch.setattr(L, "DEPTH", 0)
    assert found(L.repeated_lines(make(rows))) == want


def chance(n, planted):
    """Lines that have eight bytes in common and nothing else, but for planted ones one or two edits from another."""
    r = random.Random(12)
    word = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    rows = ["the road" + word(16) for _ in range(n)]
    return [(i, x) for i, x in enumerate(rows)] + [(n + i, rows[i * 7][:12] + "0" + rows[i * 7][13 + i % 2 :]) for i in range(planted)]


def test_many_lines_that_meet_by_chance(make, monkeypatch):
    """Over ALL_PAIRS lines of one short segment that have nothing else in common aren't cut again and again."""
    monkeypatch.setattr(L, "_connected", None)
    rows = chance(700, 40)
    assert len(rows) > 2 * L.ALL_PAIRS
    assert found(L.repeated_lines(make(rows))) == {(700 + i, 0, i * 7, 0) for i in range(40)}


def test_texts_of_many_lines(make, monkeypatch):
    """Beyond FEW_TEXTS lines their texts come by the filter of bits, full or not, with the same result."""
    want = brute(sample(3))
    monkeypatch.setattr(L, "FEW_TEXTS", 0)
    for bits in (27, 3):
        monkeypatch.setattr(L, "FILTER_BITS", bits)
        assert len(want) > 10 and found(L.repeated_lines(make(sample(3)))) == want


def test_texts_that_share_a_doc_id(spark, make):
    boiler = "this line of boilerplate stands in many documents"
    rows = [(1, boiler), (7, "some words of the first text\n" + boiler + "\n" + "that are its own " * 9), (7, "a first line of the other text\nand a second line that is nowhere else\n" + "more of it " * 9)]
    assert found(L.repeated_lines(make(rows))) == {(7, 1, 1, 0)}
    got = sorted(x["text"] for x in L.stage_line_dedup(spark, make(rows), "").collect())
    assert got == sorted([boiler, rows[1][1].replace(boiler + "\n", ""), rows[2][1]])


def test_half_repeated_documents(spark, make):
    """Documents that repeat a quarter to two thirds of their bytes and are no near copies lose what they repeat."""
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passage = words(60)
    rows = [(0, f"{words(80)}\n{passage}")] + [(n, f"{passage}\n{words(n)}") for n in (40, 60, 90, 120, 180)]
    got = {x["doc_id"]: x["text"] for x in L.stage_line_dedup(spark, make(rows), "").collect()}
    assert got == {0: rows[0][1]} | {n: t.split("\n")[1] for n, t in rows[1:]}


def test_copies_stay_whole(spark, make):
    """A near copy keeps the lines of its original, loses those of others, and doesn't keep a line from others."""
    r = random.Random(10)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    boiler, one, two, extra = words(12), words(80), words(70), words(9)
    rows = [(1, f"{boiler}\n{words(40)}"), (2, f"{one}\n{two}\n{boiler}"), (3, f"{one}\n{boiler}\n{two}\n{extra}"), (4, f"{extra}\n{words(50)}"), (5, f"{words(30)}\n{extra}")]
    got = {x["doc_id"]: x["text"] for x in L.stage_line_dedup(spark, make(rows), "").collect()}
    assert got[2] == f"{one}\n{two}" and got[3] == f"{one}\n{two}\n{extra}" and got[4] == rows[3][1] and got[5] == rows[4][1].split("\n")[0]


def test_same_as_brute_force(make):
    rows = sample(3)
    want = brute(rows)
    assert len(want) > 40 and found(L.repeated_lines(make(rows, clash=True))) == want


def test_odd_rows(make, odd):
    rows = [*odd, (20, "a line that is long enough to count\r\n  A second line of some length"), (21, "x\n\n a line that is long enough to count"), (22, "a line that is lung enough to counts")]
    got = found(L.repeated_lines(make(rows)))
    assert got == brute(rows) and (21, 2, 20, 0) in got and (22, 0, 20, 0) in got
    assert L.repeated_lines(make([])).count() == 0


def test_stage(spark, make, odd):
    boiler = "this line of boilerplate stands in many documents"
    rows = [*odd, (30, boiler + "\n" + "first own text " * 20), (31, "second own text " * 20 + "\n" + boiler), (32, boiler)]
    docs = make(rows, clash=True)
    out = L.stage_line_dedup(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[30]["text"].startswith(boiler) and got[31]["text"] == "second own text " * 20 and got[31]["n_chars"] == len(got[31]["text"])
    assert got[32]["text"] == ""  # all of it stands in another document that it is no near copy of
    assert got[1]["text"] is None and got[2]["text"] == "" and L.stage_line_dedup(spark, make([]), "").count() == 0


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    df = spark.createDataFrame(pairs, "a long, b long")
    one = {(x["id"], x["root"]) for x in components(df).collect()}
    assert one == {(x["id"], x["root"]) for x in components(df, one_task=3).collect()}
    assert {x for x in one if x[0] >= 1000} == {(1000 + i, 1000) for i in range(41)}
    assert components(df.limit(0)).count() == 0


def test_probes_find_what_they_must():
    """Every pair within k edits shares an offer and a probe."""
    from lodestar.llm.blocks import block_of
    import pyarrow as pa

    r = random.Random(2)
    for k in (1, 2, 3):
        for _ in range(60):
            a = [r.choice("abc") for _ in range(r.randint(40, 60))]
            b = list(a)
            for _ in range(k):
                at = r.randrange(len(b))
                r.choice([lambda: b.__setitem__(at, "z"), lambda: b.pop(at), lambda: b.insert(at, "q")])()
            rows = []
            for x in (a, b):
                block = block_of(pa.array(["".join(x)]))
                rows.append(L.index_rows(block, np.array([0]), np.array([len(x)]), np.array([1]), k))
            x, y = ({(int(w["key"]), role) for w in z for role in (1, 2) if w["role"] & role} for z in rows)
            assert any((key, 3 - role) in y for key, role in x)
