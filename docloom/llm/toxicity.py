"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and counts of a fixed list of insults and of words and word starts learned from
the labels, how near they stand to second-person words, the rates of capitals, exclamation and question marks and of
letters masked by digits or symbols (with insults that only show once unmasked), and the length.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, drawn by a hash of doc_id among those that may be learned
from and written once. All of them serve every step, in ``FOLDS`` folds, so that nothing is fitted and used on the same
rows: a row's word features come from the words of the other folds, and calibration sees each row's margin under trees
fitted on the other folds. Words are counted by Spark; what reaches the driver is bounded by ``LEXICON`` entries for each
fold and by the sample's rows of features. Scoring is one pass without a shuffle. Labels, lang, source and doc_id are no
inputs.

Null and empty texts: all features zero, and the score that these get. With fewer than two labelled rows of either class,
nothing tells texts apart and every score is the class share, but below the threshold. Repeated doc_ids: each row is
scored; for learning, a doc_id gives one row (that with the least text hash) and its labels are taken once, the larger
first. Empty table: no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions, rows_of, sliced, table

SAMPLE_ROWS, LEXICON, MIN_DOCS, MIN_ODDS, START, FOLDS = 16_000, 3_000, 3, 4.0, 5, 5
THRESHOLD = 0.3
#: Common insults, in English and in the other languages of the tables.
INSULTS = frozenset("""
asshole bastard bitch clown crap cretin damn disgusting dumb dumbass fool garbage hate hateful idiot idiotic imbecile
jerk kill loser lunatic moron moronic nasty pathetic pig psycho pussy retard retarded scum scumbag shit shitty shut
slut sucker stupid trash ugly vermin vile whore worthless wretch
arschloch depp dummkopf hure idioten mistkerl scheisse trottel verdammt wichser
connard connasse crétin enculé imbécile merde ordure pute salaud salope
cabrón estúpido estúpida gilipollas hijueputa imbécil mierda pendejo puta zorra
""".split())
#: Second-person words of the same languages.
SECOND = frozenset("""
you your yours yourself yourselves u ur youre du dich dir dein deine deiner ihr euch euer sie
tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro contigo
""".split())
FEATURES = 20
#: Bytes to words: letters drop case, punctuation becomes a blank; digits and the symbols that mask letters stay.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 or c in b"@$*'" else 32 for c in range(256))
UNMASK = bytes.maketrans(b"0134578@$", b"oieastbas")
MASKED = re.compile(rb"[A-Za-z][0-9@$*!]+[A-Za-z]")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def features(text: str | None, learned: dict[bytes, float]) -> np.ndarray:
    """The dense features of one text. learned: log-odds of words, and of word starts followed by ``*``."""
    raw = (text or "").encode()
    words, found = raw.translate(WORDS).split(), np.zeros(FEATURES, np.float32)
    n = len(words)
    if not n:
        return found
    fixed = [i for i, w in enumerate(words) if w in _INSULTS]
    own = [(i, learned[w]) for i, w in enumerate(words) if w in learned]
    starts = [(i, learned[w[:START] + b"*"]) for i, w in enumerate(words) if w[:START] + b"*" in learned]
    masked = MASKED.findall(raw)
    unmasked = sum(w.translate(UNMASK).replace(b"*", b"") in _INSULTS for w in words if not w.isalpha() and len(w) > 2 and w.isascii()) if masked else 0
    hits = sorted({*fixed, *(i for i, _ in own), *(i for i, _ in starts)})
    near = sum(any(w in _SECOND for w in words[max(0, i - 3) : i + 4]) for i in hits)
    at = np.array(hits)
    close = int((np.searchsorted(at, at + 50) - np.arange(len(at))).max()) if hits else 0
    caps = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    found[:] = (
        len(fixed), len(fixed) / n, len(own), len(own) / n, sum(x for _, x in own) / n, max((x for _, x in own), default=0),
        len(starts), len(starts) / n, sum(x for _, x in starts) / n, len(hits), len(hits) / n, close, near, near / n,
        caps / len(raw), (raw.count(b"!") + raw.count(b"?")) / n, len(masked) / n, unmasked, unmasked / n, np.log1p(n),
    )
    return found


_INSULTS, _SECOND = (frozenset(w.encode() for w in x) for x in (INSULTS, SECOND))


class Trees:
    """Boosted regression trees on binned features, for the logistic loss."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(np.unique(c)) > self.bins else np.unique(c)[:-1] for c in x.T]
        binned = self._binned(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        # a leaf has at least this much weight: less where there are few rows, so that they can be told apart at all
        self.floor = min(self.least, 0.02 * len(y) * p * (1 - p))
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += tree[2][leaf]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], 1).astype(np.int16)

    def _grow(self, binned, grad, hess):
        """A complete tree: split feature and bin of each inner node, and the leaves' values."""
        feature, cut, node = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, 1 << 14), np.zeros(len(grad), int)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f in range(binned.shape[1]):
                k = (node - first) * (self.bins + 1) + binned[:, f]
                g, h = (np.bincount(k, v, width * (self.bins + 1)).reshape(width, -1).cumsum(1) for v in (grad, hess))
                gl, hl, g, h = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                gain[(hl < self.floor) | (h - hl < self.floor)] = 0
                for i in np.flatnonzero(gain.max(1) > best):
                    best[i], feature[first + i], cut[first + i] = gain[i].max(), f, gain[i].argmax()
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        leaf = node - (2**self.depth - 1)
        g, h = (np.bincount(leaf, v, 2**self.depth) for v in (grad, hess))
        return (feature, cut, -self.rate * g / (h + self.ridge)), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, total = self._binned(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return total


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best rising fit of y over score (pool adjacent violators); np.interp joins them."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, v in zip(score[order], y[order]):
        blocks.append([v, 1, s, s])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            v, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v, blocks[-1][1] + n, blocks[-1][2], last]
    return np.array([x for b in blocks for x in b[2:]]), np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


class Model:
    def __init__(self, learned: dict[bytes, float], trees: Trees | None, points, share: float):
        self.learned, self.trees, self.points, self.share = learned, trees, points, share

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), min(self.share, THRESHOLD - 0.01))
        m = self.trees.margin(np.stack([features(t, self.learned) for t in texts]))
        # the trees' own order is kept within a flat step of the calibration
        return np.clip(0.98 * np.interp(m, *self.points) + 0.02 / (1 + np.exp(-m)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``rows`` labelled documents of ``docs``, one row per doc_id."""
    known = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    learnable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~_held(F.col("doc_id"), 4, 2))
    drawn = known.join(learnable.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(rows)
    drawn = docs.sparkSession.createDataFrame(drawn.toPandas(), "doc_id long, y int")  # ids and labels of the bounded sample
    once = learnable.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    once = once.repartition(partitions(docs), "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    sample = materialise(once, "toxicity-sample")

    def tokens(batches):
        """Counts of each word and fold, handed on before they grow large."""

        def told(count: dict[tuple[bytes, int], list[int]]) -> pa.RecordBatch:
            columns = [pa.array([w for w, _ in count], pa.binary()), pa.array([f for _, f in count], pa.int32())]
            return pa.record_batch([*columns, *(pa.array([n[y] for n in count.values()], pa.int64()) for y in (0, 1))], ["token", "fold", "clean", "toxic"])

        count: dict[tuple[bytes, int], list[int]] = {}
        for texts, ys, folds in rows_of(sliced(batches, 64), "text", "y", "fold"):
            for t, y, f in zip(texts, ys, folds):
                words = set(words_of(t))
                for w in words | {w[:START] + b"*" for w in words if len(w) > START}:
                    count.setdefault((w, f), [0, 0])[y] += 1
            if len(count) > 50_000:
                yield told(count)
                count = {}
        yield told(count)

    n = np.zeros((FOLDS, 2), int)
    for r in sample.groupBy("fold", "y").count().collect():
        n[r["fold"], r["y"]] = r["count"]
    each = [F.sum(F.when(F.col("fold") == f, F.col(c))).alias(f"{c}_{f}") for f in range(FOLDS) for c in ("clean", "toxic")]
    counted = sample.select("text", "y", "fold").mapInArrow(tokens, "token binary, fold int, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), *each)
    counted = materialise(counted.where(F.col("toxic") >= MIN_DOCS).na.fill(0), "toxicity-words")

    def lexicon(left_out: int | None) -> dict[bytes, float]:
        """Log-odds of the words that tell toxic texts apart, without the texts of one fold; at most ``LEXICON``."""
        clean, toxic, total = F.col("clean"), F.col("toxic"), n.sum(0)
        if left_out is not None:
            clean, toxic, total = clean - F.col(f"clean_{left_out}"), toxic - F.col(f"toxic_{left_out}"), total - n[left_out]
        odds = F.log((toxic + 0.5) / float(total[1] + 1)) - F.log((clean + 0.5) / float(total[0] + 1))
        best = counted.where(toxic >= MIN_DOCS).select("token", odds.alias("odds")).where(F.col("odds") >= np.log(MIN_ODDS)).orderBy(F.desc("odds"), "token").limit(LEXICON)
        return {bytes(r.token): float(r.odds) for r in best.collect()}

    y_all, share = n.sum(0), float(n[:, 1].sum() / max(1, n.sum()))
    if y_all.min() < 2:
        return Model({}, None, None, share)
    learned, without = lexicon(None), [lexicon(f) for f in range(FOLDS)]

    def vectors(batches):
        for texts, ys, folds in rows_of(sliced(batches, 256), "text", "y", "fold"):
            x = [features(t, without[f]).tobytes() for t, f in zip(texts, folds)]
            yield pa.record_batch([pa.array(x, pa.binary()), pa.array(ys, pa.int32()), pa.array(folds, pa.int32())], ["x", "y", "fold"])

    seen = sample.select("text", "y", "fold").mapInArrow(vectors, "x binary, y int, fold int").toPandas().sort_values(["fold", "y", "x"])
    x, y, fold = np.stack([np.frombuffer(b, np.float32) for b in seen["x"]]), seen["y"].to_numpy(float), seen["fold"].to_numpy()
    # margins of rows that neither the words nor the trees have seen
    apart = np.full(len(y), np.nan)
    for f in range(FOLDS):
        own, others = fold == f, fold != f
        if own.any() and len(set(y[others])) == 2:
            apart[own] = Trees().fit(x[others], y[others]).margin(x[own])
    tuned = ~np.isnan(apart)
    if len(set(y[tuned])) < 2:
        return Model(learned, None, None, share)
    return Model(learned, Trees().fit(x, y), isotonic(apart[tuned], y[tuned]), share)


def _held(doc_id, folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of each row of ``docs``."""

    def work(batches):
        for ids, texts in rows_of(sliced(batches), "doc_id", "text"):
            s = model.score(texts)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double, predicted int")


def is_toxic(text: Column, model: Model) -> Column:
    """Whether a text's score reaches the threshold; for filters, so that whole rows need no join."""

    @F.pandas_udf("boolean")
    def judged(t):
        return t.__class__(model.score(t.tolist()) >= THRESHOLD)

    return judged(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", _held(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
