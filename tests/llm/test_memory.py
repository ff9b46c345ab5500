"""What executors hold: batches of bounded bytes, and memory that is handed back between steps."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np

from lodestar.llm import lines, quality, runs

CLUSTER = '''
import re, sys, time
from pathlib import Path
import psutil
from pyspark.sql import SparkSession
from lodestar.llm.common import tidy

spark = SparkSession.builder.master("local-cluster[1,2,1200]").config(map={"spark.executor.memory": "1000m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def mb():
    own = [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
    return sum(int(re.search(r"Pss_Anon:\\s+(\\d+)", Path(f"/proc/{p.pid}/smaps_rollup").read_text())[1]) for p in own) >> 10

spark.range(0, 1500, 1, 2).selectExpr("repeat(string(id), 30000) as x").groupBy().agg({"x": "collect_list"}).selectExpr("size(`collect_list(x)`)").collect()
before = mb()
tidy(spark)
time.sleep(3)
print("MB", before, mb())
'''


def test_executors_hand_memory_back(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    import pyspark

    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    env.pop("PYSPARK_GATEWAY_PORT", None), env.pop("PYSPARK_GATEWAY_SECRET", None)
    said = subprocess.run([sys.executable, "-c", CLUSTER], env=env, capture_output=True, text=True, timeout=120)
    assert "MB " in said.stdout, said.stderr[-3000:]
    before, after = (int(x) for x in said.stdout.split("MB ")[1].split())
    assert before > 400 and after < 0.7 * before, (before, after)


def test_parcels_are_small_and_whole():
    rng = np.random.default_rng(5)
    rows = np.zeros(300_000, dtype=lines.ROW)
    rows["key"], rows["id"] = rng.integers(0, 1 << 63, len(rows)), np.arange(len(rows))
    got = list(runs.parcels(rows, 200))
    assert len(got) > 4 and max(b.nbytes for b in got) < 2 * runs.PARCEL_BYTES
    one = runs.pack(rows, 200)
    assert [x for b in got for x in b.to_pylist()] == one.to_pylist()
    assert list(runs.parcels(rows[:0], 200)) == []


def test_quality_judges_in_lean_batches_as_the_forest_does(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.limit(1).selectExpr(*[f"cast(null as string) as {c}" if c in ("text", "lang") else c for c in docs.columns]))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    out = quality.stage_quality(spark, docs, sf_dir)
    assert spark.conf.get(name) == before
    # No batches of the session's size: the rows themselves don't pass through Python.
    assert "ArrowEvalPython" not in out._jdf.queryExecution().toString()
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    wanted = docs.where(quality.keep_column(spark, model))
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert out.exceptAll(wanted).count() == 0 == wanted.exceptAll(out).count()
