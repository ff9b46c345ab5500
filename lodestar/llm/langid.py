"""Language identification of mixed texts: script ranges, word scores, Viterbi with a switching penalty.

Every word's script narrows its candidate languages.  Its score under each
candidate is the log-probability of its character trigrams, learned from
documents with a ``lang``.  A Viterbi pass over the words, paying a penalty
for each switch, labels spans.  The pass runs on all texts of a block at
once: texts are cut into runs of ``RUN`` words, each run's max-plus
transition is computed from every entry language in parallel, the runs are
chained, and the best path is read backwards.  That is the exact Viterbi
path, over all words of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Block, blocks, mix
from .common import table

SLOTS = 1 << 16
RUN = 48
#: Code points by script; what lies outside counts as Latin.  A script no training language uses has code "und".
SCRIPTS: dict[str, list[tuple[int, int]]] = {
    "latin": [(0x0000, 0x0370), (0x1E00, 0x1F00), (0x2C60, 0x2C80), (0xA720, 0xA800), (0xFF21, 0xFF5B)], "greek": [(0x0370, 0x0400), (0x1F00, 0x2000)], "cyrillic": [(0x0400, 0x0530), (0x1C80, 0x1C90), (0x2DE0, 0x2E00), (0xA640, 0xA6A0)],
    "armenian": [(0x0530, 0x0590)], "hebrew": [(0x0590, 0x0600), (0xFB1D, 0xFB50)], "arabic": [(0x0600, 0x0700), (0x0750, 0x0780), (0x08A0, 0x0900), (0xFB50, 0xFE00), (0xFE70, 0xFF00)],
    "devanagari": [(0x0900, 0x0980)], "bengali": [(0x0980, 0x0A00)], "gurmukhi": [(0x0A00, 0x0A80)], "gujarati": [(0x0A80, 0x0B00)], "oriya": [(0x0B00, 0x0B80)], "tamil": [(0x0B80, 0x0C00)], "telugu": [(0x0C00, 0x0C80)],
    "kannada": [(0x0C80, 0x0D00)], "malayalam": [(0x0D00, 0x0D80)], "sinhala": [(0x0D80, 0x0E00)], "thai": [(0x0E00, 0x0E80)], "lao": [(0x0E80, 0x0F00)], "tibetan": [(0x0F00, 0x1000)], "myanmar": [(0x1000, 0x10A0)],
    "georgian": [(0x10A0, 0x1100), (0x1C90, 0x1CC0), (0x2D00, 0x2D30)], "hangul": [(0x1100, 0x1200), (0x3130, 0x3190), (0xA960, 0xA980), (0xAC00, 0xD7FC)], "ethiopic": [(0x1200, 0x13A0), (0x2D80, 0x2DE0)], "khmer": [(0x1780, 0x1800)],
    "mongolian": [(0x1800, 0x18B0)], "kana": [(0x3040, 0x3100), (0x31F0, 0x3200), (0xFF66, 0xFFA0)], "han": [(0x2E80, 0x2FE0), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)],
}
_RANGES = sorted((a, z, k) for k, own in enumerate(SCRIPTS.values()) for a, z in own)
_RANGE_FROM, _RANGE_TO, _RANGE_OF = (np.array(x) for x in zip(*_RANGES))


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script of each code point, by number; 0 where no range holds it."""
    at = np.searchsorted(_RANGE_FROM, points, side="right") - 1
    return np.where(points < _RANGE_TO[at], _RANGE_OF[at], 0)


def trigram_slots(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A slot for each byte of a word, from the byte and the two before it (a space before the word); word bounds."""
    starts, ends, bounds = block.words()
    data = block.folded.astype(np.uint32)
    one = np.concatenate((np.zeros(1, np.uint32), data[:-1])) if len(data) else data
    two = np.concatenate((np.zeros(1, np.uint32), one[:-1])) if len(data) else data
    if len(starts):
        one = one.copy()
        one[starts] = 32
        two[starts] = 32
        nxt = starts[ends - starts > 1] + 1
        two[nxt] = 32
    key = data + (one << 8) + (two << 16)
    key ^= key >> 15
    key *= np.uint32(0x2C1B3C6D)
    key ^= key >> 12
    return (key & np.uint32(SLOTS - 1)).astype(np.int64), starts, ends, bounds


class LanguageModel:
    def __init__(self, langs: list[str], logs: np.ndarray, scripts: np.ndarray, penalty: float):
        #: logs: slot by language; scripts: script by language, True where the language uses the script
        self.langs, self.logs, self.scripts, self.penalty = langs, logs, scripts, penalty


def fit(docs: DataFrame, fit_rows: int = 4_000, penalty: float = 12.0, seed: int = 11) -> LanguageModel:
    """Trigram counts of at most fit_rows documents with a language and text (lowest hash first).

    Rows with a null or empty lang or text don't take part.
    """
    rows = (
        docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and lang <> ''")
    )
    picked = rows.select("doc_id", "lang").orderBy(F.xxhash64("doc_id", "lang", F.lit(seed)), "doc_id", "lang").limit(fit_rows)
    rows = rows.join(F.broadcast(picked.distinct()), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches):
        slots: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for block in blocks(b.column(1)):
                at, starts, ends, bounds = trigram_slots(block)
                inside = block.word_mask()
                script = word_scripts(block)
                for i in range(len(block)):
                    lang = langs[block.first + i]
                    lo, hi = block.offsets[i], block.offsets[i + 1]
                    slots.setdefault(lang, np.zeros(SLOTS, np.int64))
                    scripts.setdefault(lang, np.zeros(len(SCRIPTS), np.int64))
                    slots[lang] += np.bincount(at[lo:hi][inside[lo:hi]], minlength=SLOTS)
                    scripts[lang] += np.bincount(script[bounds[i] : bounds[i + 1]], minlength=len(SCRIPTS))
        for lang, c in slots.items():
            full = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full)), pa.array(full), pa.array(c[full])], names=["lang", "slot", "n"])
            s = np.arange(len(SCRIPTS))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s)), pa.array(-1 - s), pa.array(scripts[lang])], names=["lang", "slot", "n"])

    # At most 65,543 rows a language, whatever the size of the corpus.
    got = rows.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((SLOTS, max(1, len(langs))))
    scripts = np.zeros((len(SCRIPTS), max(1, len(langs))), dtype=bool)
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        at, n = own["slot"].to_numpy(), own["n"].to_numpy()
        counts[at[at >= 0], k] = n[at >= 0]
        use = np.zeros(len(SCRIPTS))
        use[-1 - at[at < 0]] = n[at < 0]
        scripts[:, k] = use > 0.001 * max(1, use.sum())
    logs = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * SLOTS))
    return LanguageModel(langs, logs.astype(np.float32), scripts, penalty)


def word_scripts(block: Block) -> np.ndarray:
    """The script of each word: that of its characters which has the highest number, so Latin only if all are."""
    starts, ends, _ = block.words()
    if not len(starts):
        return np.zeros(0, np.int64)
    # A character's script stands at its first byte; characters below U+0370 are Latin.
    lead = np.flatnonzero(block.data >= 0xCD)
    if not len(lead):
        return np.zeros(len(starts), np.int64)
    padded = np.concatenate((block.data, np.zeros(4, np.uint8))).astype(np.int64)
    b = [padded[lead + k] & 63 for k in range(4)]
    first = block.data[lead].astype(np.int64)
    two, three, four = (first & 31) << 6 | b[1], (first & 15) << 12 | b[1] << 6 | b[2], (first & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3]
    script = np.zeros(len(block.data) + 1, np.int16)
    script[lead] = scripts_of(np.where(first < 0xE0, two, np.where(first < 0xF0, three, four)))
    flat = np.empty(len(starts) * 2, dtype=np.int64)
    flat[0::2], flat[1::2] = starts, ends
    return np.maximum.reduceat(script, flat)[::2].astype(np.int64)


def word_scores(block: Block, model: LanguageModel) -> np.ndarray:
    """Words by languages; a language that doesn't use the word's script is ruled out, unless no language does."""
    slots, starts, ends, _ = trigram_slots(block)
    out = np.empty((len(starts), len(model.langs)), dtype=np.float32)
    total = np.zeros(len(slots) + 1)
    for k in range(len(model.langs)):
        np.cumsum(model.logs[slots, k], out=total[1:])
        out[:, k] = total[ends] - total[starts]
    able = model.scripts[word_scripts(block)]
    some = able.any(1)
    out[~some] = 0
    out[some[:, None] & ~able] = -1e4
    return out


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, by text; ties go to staying, then to the first language."""
    words, k = scores.shape
    best = np.zeros(words, dtype=np.int16)
    if not words or k == 1:
        return best
    count = np.diff(bounds)
    runs_of = -(-count // RUN)
    n = int(runs_of.sum())
    run_text = np.repeat(np.arange(len(count)), runs_of)
    run_no = np.arange(n) - np.repeat(np.cumsum(runs_of) - runs_of, runs_of)
    first = bounds[:-1][run_text] + run_no * RUN
    size = np.minimum(RUN, bounds[1:][run_text] - first)
    order = np.argsort(-size, kind="stable")
    first, size, run_text, run_no = first[order], size[order], run_text[order], run_no[order]
    pen = np.float32(penalty)
    # value[r, entry, now]: best score of run r's words so far if its first word is in language entry.
    value = np.full((n, k, k), np.float32(-3e38))
    value[:, np.arange(k), np.arange(k)] = scores[first]
    came = np.zeros((RUN, n, k, k), dtype=np.int8 if k < 128 else np.int16)
    for t in range(1, int(size[0]) if n else 0):
        m = int(np.searchsorted(-size, -t, side="left"))
        if not m:
            break
        now = value[:m]
        top = now.argmax(2)
        high = np.take_along_axis(now, top[:, :, None], 2) - pen
        switch = high > now
        came[t, :m] = np.where(switch, top[:, :, None], np.arange(k))
        value[:m] = np.maximum(now, high) + scores[first[:m] + t][:, None, :]
    # Chain the runs of each text, all texts side by side.
    at = np.empty(n, dtype=np.int64)
    base = np.cumsum(runs_of) - runs_of
    at[base[run_text] + run_no] = np.arange(n)
    texts = np.flatnonzero(runs_of > 0)
    texts = texts[np.argsort(-runs_of[texts], kind="stable")]
    deepest = int(runs_of[texts[0]])
    exit_value = value[at[base[texts]]].max(1)
    entry_of = np.zeros((n, k), dtype=np.int16)
    entry_of[at[base[texts]]] = value[at[base[texts]]].argmax(1)
    before = np.zeros((n, k), dtype=np.int16)
    for r in range(1, deepest):
        m = int((runs_of[texts] > r).sum())
        run = at[base[texts[:m]] + r]
        now = exit_value[:m]
        top = now.argmax(1)
        high = now[np.arange(m), top][:, None] - pen
        switch = high > now
        before[run] = np.where(switch, top[:, None], np.arange(k))
        enter = np.maximum(now, high)
        enter = enter - enter.max(1, keepdims=True)
        whole = enter[:, :, None] + value[run]
        entry_of[run] = whole.argmax(1)
        exit_value[:m] = whole.max(1)
    # Back: the exit language of each run, then of each word.
    leave = np.zeros(n, dtype=np.int64)
    last = at[base[texts] + runs_of[texts] - 1]
    state = exit_value.argmax(1)
    leave[last] = state
    for r in range(deepest - 1, 0, -1):
        m = int((runs_of[texts] > r).sum())
        run, prev = at[base[texts[:m]] + r], at[base[texts[:m]] + r - 1]
        leave[prev] = before[run, entry_of[run, leave[run]]]
    entry = entry_of[np.arange(n), leave].astype(np.int64)
    state = leave.copy()
    for t in range(int(size[0]) - 1, -1, -1):
        m = int(np.searchsorted(-size, -t, side="left"))
        best[first[:m] + t] = state[:m]
        if t:
            state[:m] = came[t, np.arange(m), entry[:m], state[:m]]
    return best


def label_block(block: Block, model: LanguageModel) -> tuple[np.ndarray, ...]:
    """Spans as arrays: text, first word, words, byte start, byte end, language."""
    starts, ends, bounds = block.words()
    lang = viterbi(word_scores(block, model), bounds, model.penalty)
    text = np.repeat(np.arange(len(block)), np.diff(bounds))
    new = np.ones(len(lang), dtype=bool)
    new[1:] = (lang[1:] != lang[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    to = np.append(at[1:], len(lang))
    t = text[at]
    return t, at - bounds[t], to - at, starts[at] - block.offsets[t], ends[to - 1] - block.offsets[t] if len(at) else at, lang[at]


def label_spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row a span: doc_id, span number, first word, words, byte range in the UTF-8 text, language.

    A text without words (null, empty, only signs) has one span without words, language "und"; words
    in a script of no training language keep their neighbours' language.  Of equal paths the one that stays in its
    language, then the first language by name, is taken.  Repeated rows get equal rows each.  Other columns of docs
    aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)
        for b in batches:
            ids = b.column(0)
            for block in blocks(b.column(1)):
                t, word, words, lo, hi, lang = label_block(block, m) if m.langs else (np.zeros(0, np.int64),) * 6
                have = np.zeros(len(block), dtype=bool)
                have[t] = True
                none = np.flatnonzero(~have)
                zero = np.zeros(len(none), np.int64)
                t = np.concatenate((t, none))
                order = np.argsort(t, kind="stable")
                put = lambda x, y: np.concatenate((x, y))[order]
                t = t[order]
                begin = np.searchsorted(t, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(t + block.first)), pa.array(np.arange(len(t)) - begin), pa.array(put(word, zero)), pa.array(put(words, zero)),
                        pa.array(put(lo, zero)), pa.array(put(hi, zero)), pa.array(names[put(lang.astype(np.int64), zero + len(m.langs))], type=pa.string()),
                    ],
                    names=["doc_id", "span", "word", "words", "byte_start", "byte_end", "span_lang"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        label, "doc_id long, span long, word long, words long, byte_start long, byte_end long, span_lang string"
    )


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language spans of all documents; rows as label_spans says."""
    docs = table(spark, sf_dir, "documents")
    return label_spans(docs, fit(docs))
