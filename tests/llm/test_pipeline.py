"""The pipeline on a small corpus, stage by stage against brute force."""

import sys
from pathlib import Path

import pytest

from .test_jaccard import brute as near
from .test_jaccard import grams
from .test_lines import brute as repeated

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    import corpus_pipeline

    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append(docs.collect())
    return out


def test_columns(stages):
    assert all(rows[0].asDict().keys() == stages[0][0].asDict().keys() for rows in stages[1:5])


def test_quality_keeps_rows_as_they_are(stages):
    assert set(stages[1]) <= set(stages[0]) and 0.5 < len(stages[1]) / len(stages[0]) < 1


def test_lines(stages):
    before, after = ({r["doc_id"]: r["text"] for r in rows} for rows in stages[1:3])
    assert before.keys() == after.keys()
    strip = lambda i, numbers: "\n".join(x for n, x in enumerate(before[i].split("\n")) if n not in numbers)
    repeats = repeated(list(before.items()))
    size = lambda i, n: len(before[i].split("\n")[n].strip(" \t\r").encode())
    original, copies, held = {}, {}, {}
    for i, n, j, _ in repeats:
        if i != j:
            held.setdefault(i, {}).setdefault(j, 0)
            held[i][j] += size(i, n)
    gone = {i: {n for k, n, _, _ in repeats if k == i} for i in before}
    for i, by in held.items():
        most = max(by.values())
        original[i] = {j for j, n in by.items() if n == most}
        for j in original[i]:
            x, y = grams(strip(i, {n for k, n, o, _ in repeats if k == i and o != j})), grams(strip(j, gone[j]))
            if x and y and len(x & y) >= 0.6 * len(x | y) - 1e-9:
                copies[i] = j
    assert len(copies) >= 3
    spared = {}
    for i, n, j, m in sorted(repeats):
        if j in copies and i not in copies:
            spared.setdefault((j, m), (i, n))
    for i in before:
        if len(original.get(i, ())) < 2:  # which of two equal claims is the original isn't said
            drop = {n for k, n, j, m in repeats if k == i and copies.get(i) != j and spared.get((j, m)) != (i, n)}
            assert after[i] == strip(i, drop)


def test_near_duplicates(stages):
    before, after = ({r["doc_id"]: r["text"] for r in rows} for rows in stages[2:4])
    assert set(before) - set(after) == {i for i, g, _ in near(list(before.items())) if i != g}


def test_leaks_and_plan(stages):
    before, after = ({r["doc_id"]: r["text"] for r in rows} for rows in stages[3:5])
    assert after.items() <= before.items() and 0 < len(before) - len(after) < 0.2 * len(before)
    words = {}
    for r in stages[5]:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["words"]
    assert words == {i: len(t.split()) for i, t in after.items() if t.split()}


def test_run(spark, sf_dir, stages):
    import corpus_pipeline

    key = lambda r: tuple(str(x) for x in r)
    assert sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=key) == sorted(stages[5], key=key)
