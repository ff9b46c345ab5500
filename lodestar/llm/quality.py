"""Quality rules: an isolation forest on rule statistics.

Each document becomes a short vector of rule statistics (share of capital
letters, symbols, list bars, repeated words, ...), all shrunk towards their
usual values for short texts.  A forest of random axis-parallel splits is
grown on labelled rows, bad copies counting once; documents on short paths are anomalous.  The score
threshold is calibrated on the labelled rows by language: it keeps at least
``keep_rate`` of the good ones and lies in the middle between the highest
score that they need and the lowest score of a bad one above it.

Limits, rules and thresholds come from all labelled rows, and each tree draws
its rows from all of them, as an isolation forest does; every document is
measured and scored on its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, block_of, blocks, per_text
from .common import beside, cut, keep, lean, scratch, semi, small, table, trim

RULES = ["upper", "symbol", "bar", "digit", "repeat", "word_length", "line_repeat", "space"]
#: Pseudo-counts: a text's statistic counts as if so much usual text were added.
SHRINK = {"upper": 60, "symbol": 60, "bar": 60, "digit": 120, "repeat": 12, "word_length": 12, "line_repeat": 4, "space": 60}
USUAL = {"upper": 0.02, "symbol": 0.0, "bar": 0.0, "digit": 0.0, "repeat": 0.0, "word_length": 5.0, "line_repeat": 0.0, "space": 0.16}

_SYMBOL = np.zeros(256, dtype=bool)
for _c in b"#$%&*!^~<>{}[]\\":
    _SYMBOL[_c] = True


def statistics(block: Block) -> np.ndarray:
    """Texts by rules; whole texts, any length.  An empty text has the usual values."""
    data, off = block.data, block.offsets
    starts, ends, bounds = block.words()
    size = np.diff(off).astype(float)
    count = np.diff(bounds).astype(float)

    def share(mask: np.ndarray, name: str) -> np.ndarray:
        return (per_text(mask, off) + SHRINK[name] * USUAL[name]) / (size + SHRINK[name])

    upper = (data >= 65) & (data <= 90)
    folded = block.folded
    upper |= (folded != data) & (data >= 128)
    hashes = block.word_hashes()
    # A word counts as repeated if it is among the three words before it: usual words come again, but not at once.
    again = np.zeros(len(hashes), dtype=bool)
    text_of = np.repeat(np.arange(len(block)), np.diff(bounds))
    for lag in (1, 2, 3):
        again[lag:] |= (hashes[lag:] == hashes[:-lag]) & (text_of[lag:] == text_of[:-lag])
    repeated = per_text(again, bounds)
    # Distinct words against what prose of that length has; only very repetitive texts pass the ceiling.
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(bounds[:-1], bounds[1:])], dtype=float)
    flat = np.maximum(0, np.minimum(count, 40) - distinct)
    repeat = np.maximum(repeated, flat * count / np.maximum(1, np.minimum(count, 40)))
    length = per_text(ends - starts, bounds)

    line_starts, line_ends, line_bounds = block.runs(data != 10)
    lines = _spans(block, line_starts, line_ends)
    n_lines = np.diff(line_bounds).astype(float)
    d_lines = np.array([len(np.unique(lines[a:b])) for a, b in zip(line_bounds[:-1], line_bounds[1:])], dtype=float)
    return np.column_stack([
        share(upper, "upper"),
        share(_SYMBOL[data], "symbol"),
        share(data == 124, "bar"),
        share((data >= 48) & (data <= 57), "digit"),
        repeat / (count + SHRINK["repeat"]),
        (length + SHRINK["word_length"] * USUAL["word_length"]) / (count + SHRINK["word_length"]),
        (n_lines - d_lines) / (n_lines + SHRINK["line_repeat"]),
        share(data == 32, "space"),
    ]) if len(block) else np.empty((0, len(RULES)))


def _spans(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    from .blocks import span_hash

    return span_hash(block.prefix_hash(), starts, ends)


def all_statistics(texts: pa.Array) -> np.ndarray:
    parts = [statistics(b) for b in blocks(texts)]
    return np.concatenate(parts) if parts else np.empty((0, len(RULES)))


class Forest:
    """Isolation forest in flat arrays: nodes of all trees side by side, so scoring is a vectorised descent."""

    def __init__(self, trees: int = 120, sample: int = 256, seed: int = 7):
        self.trees, self.sample, self.seed = trees, sample, seed

    @staticmethod
    def usual_path(n: float) -> float:
        """Mean path of an unsuccessful search among n points."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def fit(self, x: np.ndarray, apart: bool = False) -> Forest:
        """Each tree grows on ``sample`` rows of x at random; apart: on the next ``sample`` ones, as x is in random order."""
        rng = np.random.default_rng(self.seed)
        feature, split, left, right, path, roots = [], [], [], [], [], []
        n = min(self.sample, len(x))
        deepest = max(1, int(np.ceil(np.log2(max(2, n)))))

        def grow(rows: np.ndarray, depth: int) -> int:
            at = len(feature)
            feature.append(0), split.append(0.0), left.append(at), right.append(at), path.append(depth + self.usual_path(len(rows)))
            if depth < deepest and len(rows) > 1:
                low, high = rows.min(0), rows.max(0)
                able = np.flatnonzero(high > low)
                if len(able):
                    f = int(rng.choice(able))
                    s = float(rng.uniform(low[f], high[f]))
                    feature[at], split[at] = f, s
                    left[at] = grow(rows[rows[:, f] < s], depth + 1)
                    right[at] = grow(rows[rows[:, f] >= s], depth + 1)
            return at

        for t in range(self.trees):
            rows = x[t * n : t * n + n] if apart else x[rng.choice(len(x), n, replace=False)] if n else x
            roots.append(grow(rows, 0))
        self.feature, self.split = np.array(feature), np.array(split)
        self.left, self.right, self.path = np.array(left), np.array(right), np.array(path)
        self.roots, self.depth, self.norm = np.array(roots), deepest, max(self.usual_path(n), 1e-9)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / usual path): near 1 is anomalous, under a half is ordinary."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] < self.split[at], self.left[at], self.right[at])
            total += self.path[at]
        return 2.0 ** -(total / len(self.roots) / self.norm)


class QualityModel:
    """A forest over excesses above each rule's limit, and the score above which a document is rejected.

    The cut is by language, with a general one for others.
    """

    def __init__(self, forest: Forest | None, rules: list[int], limits: np.ndarray, general: float, by_lang: dict[str, float]):
        self.forest, self.rules, self.limits = forest, rules, limits
        self.general, self.by_lang = general, by_lang

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(stats):
            return np.zeros(len(stats))
        return self.forest.score(excess(stats, self.rules, self.limits))

    def judge(self, texts: pa.Array, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stats = all_statistics(texts)
        score = self.score(stats)
        score[pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) == 0] = 0.0
        limit = np.array([self.by_lang.get(x, self.general) for x in langs]) if len(stats) else np.zeros(0)
        return stats, score, score <= limit


def excess(stats: np.ndarray, rules: list[int], limits: np.ndarray) -> np.ndarray:
    """By how much each chosen rule's limit is passed; 0 within the usual range, so that only outliers can be split off."""
    return np.maximum(0.0, stats[:, rules] - limits[rules])


def ranked(values: DataFrame, ranks: dict[str, list[int]]) -> dict[str, list[float]]:
    """Of each key the values of some ranks (0 is the least), exactly; values: rows of key and value, none negative.

    Doubles that aren't negative are in the order of their bits, so these are counted 16 at a time, from the highest
    ones down, among the values that share the bits found so far.
    """
    found = {k: [(0, r) for r in own] for k, own in ranks.items()}
    for shift in (48, 32, 16, 0):
        begun = {k: np.unique([x for x, _ in own]) for k, own in found.items()}

        def count(batches, shift=shift, begun=begun):
            for b in batches:
                key, bits = b.column(0).to_pandas(), (b.column(1).to_numpy() + 0.0).view(np.int64)
                for k, own in begun.items():
                    x = bits[(key == k).to_numpy()] >> shift
                    at, n = np.unique(x[np.isin(x >> 16, own)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), type=pa.string()), pa.array(at), pa.array(n)], names=["key", "at", "n"])

        got = values.select("key", "value").mapInArrow(count, "key string, at long, n long").groupBy("key", "at").agg(F.sum("n").alias("n")).toPandas().sort_values("at")
        for k, own in found.items():
            at, n = (got.loc[got["key"] == k, c].to_numpy() for c in ("at", "n"))
            for i, (x, r) in enumerate(own):
                mine = at >> 16 == x
                total = np.cumsum(n[mine])
                j = int(np.searchsorted(total, r, side="right"))
                own[i] = int(at[mine][j]), r - int(total[j] - n[mine][j])
    return {k: [float(np.int64(x).view(np.float64)) for x, _ in own] for k, own in found.items()}


def choose_rules(rows: DataFrame, n: int, n_good: int, usual_rate: float = 0.997, least_share: float = 0.02) -> tuple[list[int], np.ndarray]:
    """Limits of all rules (a high quantile over good rows) and the rules that at least least_share of bad rows pass."""
    base = rows.where("good > 0") if n_good else rows
    at = ((n_good or n) - 1) * usual_rate
    low, part = int(at), at - int(at)
    values = base.select(F.explode(F.array(*[F.struct(F.lit(r).alias("key"), F.col(r).alias("value")) for r in RULES])).alias("x")).select("x.*")
    got = ranked(values, {r: [low, min(low + 1, (n_good or n) - 1)] for r in RULES})
    limits = np.array([a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part) for a, b in (got[r] for r in RULES)])
    passed = rows.where("good = 0").agg(*[F.avg((F.col(r) > float(x)).cast("double")) for r, x in zip(RULES, limits)]).head()
    rules = [k for k in range(len(RULES)) if (passed[k] or 0) >= least_share]
    return rules or list(range(len(RULES))), limits


def calibrate(scored: DataFrame, keep_rate: float, least: int) -> tuple[float, dict[str, float]]:
    """The general cut and those of languages with enough rows, of all rows of lang, good and score.

    A cut keeps keep_rate of the good rows: in the middle between the score that takes and the next bad one above; a score of the cut itself is kept.
    """
    by = scored.select("good", "score", F.explode(F.array(F.lit("*"), F.concat(F.lit("="), "lang"))).alias("key")).where("key is not null")
    bad = F.when(F.col("good") == 0, F.col("score"))
    counts = by.groupBy("key").agg(F.count("*").alias("n"), F.count(bad).alias("bad"), F.max(bad).alias("most")).collect()
    counts = {x["key"]: x for x in counts if x["key"] == "*" or x["n"] >= least and x["bad"] >= least // 10}
    ranks = {k: [int(np.ceil((x["n"] - x["bad"] - 1) * keep_rate))] for k, x in counts.items() if x["n"] > x["bad"]}
    floors = {k: x for k, (x,) in ranked(by.where("good > 0").select("key", F.col("score").alias("value")), ranks).items()}
    above = {}
    if floors:
        floor = by.sparkSession.createDataFrame(list(floors.items()), "key string, floor double")
        above = {x["key"]: x["above"] for x in by.where("good = 0").join(F.broadcast(floor), "key").where("score > floor").groupBy("key").agg(F.min("score").alias("above")).collect()}
    # Between the best good score allowed and the lowest bad one above it: the middle of the gap.
    cuts = {k: float("inf") if k not in floors or not x["bad"] else (floors[k] + above[k]) / 2 if k in above else floors[k] for k, x in counts.items()}
    return cuts["*"], {k[1:]: x for k, x in cuts.items() if k != "*"}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the rule statistics of all documents."""

    def measure(batches):
        for b in batches:
            stats = all_statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)] + [pa.array(stats[:, k]) for k in range(len(RULES))], names=["doc_id", "lang", *RULES])
        trim()

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return docs.mapInArrow(measure, "doc_id long, lang string, " + ", ".join(f"{r} double" for r in RULES))


def fit(docs: DataFrame, labels: DataFrame, keep_rate: float = 0.999, least: int = 200, seed: int = 7) -> QualityModel:
    """Fit on all labelled documents.

    Rows with a null doc_id, label or text don't take part.  Without labelled rows every document is kept.
    Trees that together need fewer rows than there are draw them apart: no row is in two of them.
    """
    spark = docs.sparkSession
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_good")).where("doc_id is not null and _good is not null")
        .groupBy("doc_id").agg(F.min("_good").alias("_good")).select("doc_id", (F.col("_good") > 0).cast("int").alias("good"))
    )
    docs = docs.select("doc_id", "text", "lang").where("text is not null")
    with scratch(spark):
        # Labels that are too many to be broadcast meet the statistics, so that no text is shuffled.
        rows = cut(measured(semi(docs, picked, "doc_id") if small(picked) else docs).join(beside(picked), "doc_id"))
        n, n_good = rows.agg(F.count("*"), F.sum("good")).head()
        if not n:
            return QualityModel(None, [], np.zeros(len(RULES)), float("inf"), {})
        rules, limits = choose_rules(rows, n, n_good)
        names = [RULES[k] for k in rules]
        over = rows.select("doc_id", "good", *[F.greatest(F.lit(0.0), F.col(RULES[k]) - float(limits[k])).alias(RULES[k]) for k in rules])
        # Copies of one bad document would hide it in a crowd of its own: of bad rows alike the forest grows on one.
        alone = over.where("good = 0").groupBy(*names).agg(F.min("doc_id").alias("doc_id"))
        forest = Forest(seed=seed)
        most = forest.trees * forest.sample
        drawn = over.where("good > 0").select("doc_id", *names).unionByName(alone).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", *names).limit(most).toPandas()
        apart = len(drawn) == most
        if not apart:
            drawn = drawn.sort_values(["doc_id", *names], kind="stable")
        model = QualityModel(forest.fit(drawn[names].to_numpy(dtype=float), apart), rules, limits, 0.0, {})
        shared = spark.sparkContext.broadcast(model)

        def score(batches):
            for b in batches:
                stats = np.column_stack([b.column(2 + k).to_numpy() for k in range(len(RULES))])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.score(stats))], names=["lang", "good", "score"])

        scored = cut(rows.select("lang", "good", *RULES).mapInArrow(score, "lang string, good int, score double"))
        general, by_lang = calibrate(scored, keep_rate, least)
    return QualityModel(model.forest, rules, limits, general, by_lang)


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, the rule statistics, the anomaly score and whether the document is kept.

    A null or empty text has the usual statistics, an anomaly of 0 and is kept; repeated rows get the same answer each;
    other columns of docs, whatever their names, aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for b in batches:
            stats, score, keep = shared.value.judge(b.column(1), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0)] + [pa.array(stats[:, k]) for k in range(len(RULES))] + [pa.array(score), pa.array(keep)],
                names=["doc_id", *RULES, "anomaly", "keep"],
            )

    schema = "doc_id long, " + ", ".join(f"{r} double" for r in RULES) + ", anomaly double, keep boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(judge, schema)


def keep_column(spark: SparkSession, model: QualityModel) -> Column:
    """The decision as a column of the row itself, for filters that pass all other columns through."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keep(text: pa.Array, lang: pa.Array) -> pa.Array:
        out = pa.array(shared.value.judge(text, lang.to_pylist())[2])
        trim()
        return out

    return keep(F.col("text"), F.col("lang"))


def rejected(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Hash and bytes of the texts, with their languages, that the model rejects: __lodestar_hash, __lodestar_size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for b in batches:
            out = pa.array(~shared.value.judge(b.column(0), b.column(1).to_pylist())[2])
            yield pa.RecordBatch.from_arrays([b.column(2).filter(out), b.column(3).filter(out)], names=["__lodestar_hash", "__lodestar_size"])
        trim()

    rows = docs.where("text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), *_identity())
    return rows.mapInArrow(judge, "__lodestar_hash long, __lodestar_size int").distinct()


def _identity() -> list[Column]:
    """What tells rows of another text or language apart."""
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    return [F.xxhash64(text, lang, lang.isNull()).alias("__lodestar_hash"), F.octet_length(text).alias("__lodestar_size")]


def op1_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, anomaly and decision of all documents; rows as score_documents says."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the forest doesn't reject, with all their columns.

    Null and empty texts stay, rows that repeat share a decision, an anomaly equal to the cut is kept.
    """
    with scratch(spark), lean(spark):
        out = keep(rejected(docs, fit(docs, table(spark, sf_dir, "labels"))))
    same = [x == F.col(c) for x, c in zip(_identity(), out.columns)]
    return docs.join(beside(out), same, "left_anti").select(docs.columns)
