r"""Toxicity: gradient-boosted trees over dense features of a whole text, with isotonic calibration.

Features: densities of a seed lexicon and of one learned from the training labels, how near such words stand to
second-person words, capitals, punctuation and obfuscated spellings.  Labels, language, source and id are not
among them.  The trees are fitted on the driver on a sample of labelled training rows of at most ``SAMPLE`` (those with
the least hash of their id, one row for each id), so what reaches the driver is at most SAMPLE rows of some twenty
numbers.  The sample is dealt into four folds; a fold's features use a lexicon learned from the other three, so no
row is fitted or calibrated on words that its own label picked, and one fold fits the calibration only.  Scoring is one pass over all rows without a shuffle.

Defined results for odd input: a null or empty text has all-zero features and gets the score those get; rows
with a null label, or without one, are scored but not learned from; an id labelled more than once counts as
toxic if any label says so; with no training labels, or only one kind, every score is the share of toxic ones
(0 without any); repeated rows score alike; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, slices, stored, texts

SAMPLE = 20_000
LEXICON_SIZE = 300
FOLDS = 4  # the last one fits the calibration
FEW = 80  # rows from which on there are folds
#: Seed lexicon. Fixed values.
SEED = frozenset("""
idiot idiots idiotic stupid moron morons moronic loser losers scum trash garbage pathetic worthless clown clowns dumb
dumbass fool fools jerk imbecile imbeciles disgusting vermin filth filthy ugly hate retard bastard bitch asshole crap
shit fuck fucking fucked whore slut freak creep coward liar lunatic useless ignorant
dumm dummkopf arschloch scheisse scheiße blödmann versager abschaum wertlos erbärmlich
connard salaud merde crétin débile ordure minable imbécile
idiota estúpido imbécil basura escoria mierda pendejo inútil patético cabrón
""".split())
#: Second-person words. Fixed values.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton vous votre tú usted ustedes vosotros tus".split())
#: Characters that stand for letters in obfuscated spellings. Fixed values.
LEET = str.maketrans("013457@$!|", "oieastasil")
NEAR = 5
FEATURES = (
    "log_words", "seed_per_word", "seed_count", "seed_kinds", "learned_per_word", "learned_count", "learned_sum", "learned_max",
    "near_you", "you_per_word", "near_share", "caps_words", "caps_letters", "bangs", "questions", "punctuation", "obfuscated", "obfuscated_seed", "longest_run",
)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(5)) == 0


_EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_"
_ODD = re.compile(rb"[A-Za-z][0-9@$!*|][A-Za-z]")


class Words(dict):
    """What is known of a raw word: bit flags and its weight in the learned lexicon."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned

    def __missing__(self, raw: bytes) -> tuple[int, float]:
        if len(self) > 200_000:
            self.clear()
        word = raw.strip(_EDGE).decode("utf-8", "replace")
        low = word.lower()
        flags = (low in SEED) | (low in self.learned) << 1 | (low in YOU) << 2 | (len(word) > 1 and word.isupper()) << 3
        if _ODD.search(raw):
            flags |= 16 | (low.translate(LEET).replace("*", "") in SEED) << 5
        got = self[raw] = (flags, self.learned.get(low, 0.0))
        return got


def features(text: bytes, words: Words) -> np.ndarray:
    out = np.zeros(len(FEATURES))
    raw = text.split()
    if not raw:
        return out
    got = list(map(words.__getitem__, raw))
    flags = np.array([f for f, _ in got], np.int64)
    n = len(raw)
    seed, learned, you = flags & 33 > 0, flags & 2 > 0, flags & 4 > 0
    out[0] = np.log1p(n)
    out[1], out[2] = 100 * seed.mean(), seed.sum()
    if out[2]:
        out[3] = len({raw[i].strip(_EDGE).lower() for i in np.flatnonzero(seed)})
    out[4], out[5] = 100 * learned.mean(), learned.sum()
    if out[5]:
        weights = np.array([w for _, w in got])
        out[6], out[7] = weights.sum(), weights.max()
    hits, persons = np.flatnonzero(seed | learned), np.flatnonzero(you)
    if len(hits) and len(persons):
        at = np.searchsorted(persons, hits)
        gap = np.minimum(np.abs(persons[np.minimum(at, len(persons) - 1)] - hits), np.abs(hits - persons[np.maximum(at - 1, 0)]))
        out[8], out[10] = 1 / (1 + gap.min()), (gap <= NEAR).mean()
    out[9] = 100 * you.mean()
    out[11] = (flags & 8 > 0).mean()
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = b[65:91].sum(), b[97:123].sum()
    out[12] = upper / max(1, upper + lower)
    out[13], out[14] = b[33] / n, b[63] / n
    out[15] = (b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum()) / n
    out[16], out[17] = (flags & 16 > 0).mean(), (flags & 32 > 0).sum()
    if out[2] + out[5]:
        run = best = 0
        for hit in (seed | learned).tolist():
            run = run + 1 if hit else 0
            best = max(best, run)
        out[18] = best
    return out


# -- trees on the driver -------------------------------------------------------------------------------------


@dataclass
class Model:
    """Trees (feature, cut, left, right, value by node) and the isotonic steps."""

    trees: list[list[tuple[int, float, int, int, float]]]
    base: float
    steps: tuple[np.ndarray, np.ndarray] | None
    learned: dict[str, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            feature, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                go = x[np.arange(len(x)), feature[node]] <= cut[node]
                node = np.where(feature[node] < 0, node, np.where(go, left[node], right[node]))
            out += value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-self.raw(x)))
        return np.clip(np.interp(p, *self.steps), 0, 1) if self.steps else p


DEPTH, TREES, RATE, BINS, LEAF = 3, 80, 0.1, 32, 10


def fit(x: np.ndarray, y: np.ndarray, learned: dict[str, float], fold: np.ndarray) -> Model:
    """``fold``: which rows fit the calibration only."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model([], 0.0, (np.array([0.0, 1.0]), np.array([share, share])), learned)
    if y[~fold].size == 0 or y[~fold].min() == y[~fold].max():
        fold = np.zeros(len(y), bool)
    model = boosted(x[~fold], y[~fold], learned)
    if fold.any():
        model.steps = isotonic(1 / (1 + np.exp(-model.raw(x[fold]))), y[fold])
    return model


def boosted(x: np.ndarray, y: np.ndarray, learned: dict[str, float]) -> Model:
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    total, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        tree, rows_of, at = [[-1, 0.0, 0, 0, 0.0]], {0: np.arange(len(y))}, [0]
        for _ in range(DEPTH):
            following = []
            for node in at:
                split = _split(bins, g, h, rows_of[node], cuts)
                if not split:
                    continue
                j, b = split
                rows = rows_of[node]
                go = bins[rows, j] <= b
                a = len(tree)
                tree += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
                tree[node][:4] = [j, float(cuts[j][b]), a, a + 1]
                rows_of[a], rows_of[a + 1] = rows[go], rows[~go]
                following += [a, a + 1]
            at = following
        for node, rows in rows_of.items():
            if tree[node][0] < 0:
                tree[node][4] = RATE * float(g[rows].sum() / (h[rows].sum() + 1))
                total[rows] += tree[node][4]
        trees.append([tuple(t) for t in tree])
    return Model(trees, base, None, learned)


def _split(bins, g, h, rows, cuts) -> tuple[int, int] | None:
    best, out = 1e-6, None
    gs, hs = g[rows], h[rows]
    whole = gs.sum() ** 2 / (hs.sum() + 1)
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        b = bins[rows, j]
        gl, hl, n = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (gs, hs, None))
        gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1) - whole
        gain = np.where((n >= LEAF) & (len(rows) - n >= LEAF), gain, 0)
        k = int(gain.argmax())
        if gain[k] > best:
            best, out = gain[k], (j, k)
    return out


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (p, calibrated share)."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(p[order], y[order], strict=True):
        blocks.append([a, a, float(b), 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            low, high = blocks[-2], blocks.pop()
            low[1], low[2], low[3] = high[1], low[2] + high[2], low[3] + high[3]
    # A little of the pool's share in each block keeps small blocks from claiming certainty.
    share = y.mean()
    values = [(s + share) / (n + 1) for _, _, s, n in blocks]
    xs = np.array([v for lo, hi, _, _ in blocks for v in (lo, hi)])
    return xs, np.maximum.accumulate(np.repeat(values, 2))


# -- Spark ---------------------------------------------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, train: Column, most: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic, fold of at most ``most`` labelled training ids, one row for each: the text of least hash."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Hashes beyond what the sample is expected to need are left out first, so that no task has to order all ids.
    total, h = ids.count(), F.xxhash64("doc_id")
    if total > 4 * most:
        ids = ids.where(h < int(2**64 * 2 * most / total) - 2**63)
    ids = ids.orderBy(h, "doc_id").limit(most)
    # ``most`` rows of two numbers: the bound that makes the broadcast safe.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    return one.select("doc_id", "one.text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, clean, toxic): in how many clean and toxic texts of each fold a word is."""

    def run(batches):
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            labels = zip(batch.column(batch.schema.get_field_index("toxic")).to_pylist(), batch.column(batch.schema.get_field_index("fold")).to_pylist(), strict=True)
            for t, (y, fold) in zip(texts(batch), labels, strict=True):
                for w in {w.strip(_EDGE).lower() for w in t.split()}:
                    held.setdefault(w, [0] * (2 * FOLDS))[FOLDS * (y > 0) + fold] += 1
            yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode("utf-8", "replace") for w in held], pa.string())} | {f"c{k}": pa.array([c[k] for c in held.values()], pa.int64()) for k in range(2 * FOLDS)})

    columns = [f"c{k}" for k in range(2 * FOLDS)]
    found = rows.select("text", "toxic", "fold").mapInArrow(run, "word string, " + ", ".join(f"{c} long" for c in columns))
    return found.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])


def lexicon(counts: DataFrame, sizes: dict[tuple[int, int], int], without: int | None = None, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Words that toxic texts hold far more often than clean ones: log odds by word, from all folds but ``without``.

    ``sizes``: texts by (0 clean or 1 toxic, fold).
    """
    folds = [k for k in range(FOLDS) if k != without]
    n = [sum(sizes.get((y, k), 0) for k in folds) for y in (0, 1)]
    if not all(n):
        return {}
    a, b = (reduce(add, [F.col(f"c{FOLDS * y + k}") for k in folds]) for y in (0, 1))
    words = counts.select("word", a.alias("a"), b.alias("b"))
    odds = F.log((F.col("b") + 0.5) / (n[1] + 1)) - F.log((F.col("a") + 0.5) / (n[0] + 1))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = words.where("length(word) > 1 and b >= 4").select("word", odds.alias("odds"), z.alias("z")).where("odds > 1 and z > 3.5").orderBy(F.desc("z"), "word").limit(size)
    return {r.word: float(r.odds) for r in best.collect()}


def _featured(rows: DataFrame, learned: list[dict[str, float]]) -> DataFrame:
    """Features of each row by its fold's lexicon."""

    def run(batches):
        words = [Words(x) for x in learned]
        for batch in batches:
            for part in slices(batch):
                folds = part.column(part.schema.get_field_index("fold")).to_pylist()
                x = [features(t, words[k]) for t, k in zip(texts(part), folds, strict=True)]
                yield pa.RecordBatch.from_pydict({c: part.column(part.schema.get_field_index(c)) for c in ("at", "toxic", "fold")} | {"x": pa.array(x, pa.list_(pa.float64()))})

    return rows.select(F.xxhash64("doc_id").alias("at"), "text", "toxic", "fold").mapInArrow(run, "at long, toxic int, fold int, x array<double>")


def trained(docs: DataFrame, labels: DataFrame, train: Column, most: int = SAMPLE) -> Model:
    rows = stored(sample(docs, labels, train, most), "sample")
    counts = stored(word_counts(rows), "sample-words")
    sizes = {(int(r[0] > 0), r[1]): r[2] for r in rows.groupBy("toxic", "fold").count().collect()}
    few = sum(sizes.values()) < FEW
    learned = lexicon(counts, sizes)
    each = [learned] * FOLDS if few else [lexicon(counts, sizes, k) for k in range(FOLDS)]
    got = sorted((r.at, r.toxic, r.fold == FOLDS - 1 and not few, r.x) for r in _featured(rows, each).collect())
    dropped(rows, counts)
    return fit(np.array([r[3] for r in got]).reshape(len(got), len(FEATURES)), np.array([r[1] for r in got], float), learned, np.array([r[2] for r in got], bool))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        words = Words(model.learned)
        for batch in batches:
            for part in slices(batch):
                x = np.array([features(t, words) for t in texts(part)]).reshape(part.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "score": pa.array(model.score(x))})

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = trained(docs, labels, ~held_out(F.col("doc_id")))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
