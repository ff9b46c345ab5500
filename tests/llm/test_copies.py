"""Documents that repeat much of their bytes and are no copies: the pipeline takes their repeated lines too."""

import random
import sys
from pathlib import Path

from lodestar.llm.lines import repeated_lines

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_shared_passage_in_a_short_document(spark, make, tmp_path):
    from corpus_pipeline import STAGES

    r = random.Random(4)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passage, own, short, twice = words(60), words(200), words(50), words(55)
    rows = [
        (1, f"{passage}\n{own}"), (2, f"{short}\n{passage}"), (3, f"{passage}\n{own} and a little more"),
        (4, f"{twice}\n{words(20)}\n{twice}"), (5, passage), (6, None), (7, ""),
    ]
    docs = make(rows)
    for k, (_, stage) in enumerate(STAGES[1:3]):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    got = {x["doc_id"]: x for x in docs.collect()}
    assert set(got) == {1, 2, 4, 5, 6, 7} and got[1]["text"] == rows[0][1]
    assert got[2]["text"] == short and got[2]["n_chars"] == len(short)
    assert got[4]["text"] == rows[3][1].rpartition("\n")[0] and got[5]["text"] == ""
    assert repeated_lines(docs).count() == 0
