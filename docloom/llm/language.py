"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are all byte n-grams of its letters (ASCII digits, punctuation and controls count as blanks); each
falls into one of ``BUCKETS`` rows of an embedding table, the text is the mean of its rows, and a linear softmax over
that mean gives the languages. Table and softmax are trained together by stochastic gradient descent in numpy, on at
most ``SAMPLE_ROWS`` documents with a language, drawn by a hash of doc_id, one row for each; whole texts are used. A tenth of the sample
is kept from training: on it a temperature is fitted, so that a score is the chance of being right, and the score below
which a prediction counts as rejected. As the softmax is linear, embedding and weights fold into one table of
bucket x language for prediction, which is one pass without a shuffle.

Null texts and texts without a letter: ``und``, score 0, rejected. Without any row to learn from, every text is
``und``. Languages are compared as they are written. Repeated doc_ids are rows of their own. Empty table: no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table

SAMPLE_ROWS, BUCKETS, DIM, EPOCHS, BATCH = 3_000, 1 << 13, 16, 12, 32
GRAMS = (2, 3, 4)
#: Share of wrong answers among the kept ones that the rejection threshold aims at.
WRONG = 0.01
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
LETTER = re.compile(r"[^\W\d_]")


def buckets(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte, but for the last n - 1."""
    h = np.full(len(data) - n + 1, 0x9E37 + n, np.uint32)
    for j in range(n):
        h = (h ^ data[j : len(data) - n + 1 + j]) * np.uint32(0x01000193)
    return (h ^ (h >> 15)) & np.uint32(BUCKETS - 1)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(b" " + b" ".join((text or "").encode().translate(LETTERS).split()) + b" ", np.uint8)


def counts(text: str | None) -> np.ndarray:
    data = _bytes(text)
    return sum(np.bincount(buckets(data, n), minlength=BUCKETS) for n in GRAMS if len(data) >= n)


class Model:
    def __init__(self, langs: list[str], fold: np.ndarray, bias: np.ndarray, heat: float, least: float):
        self.langs, self.fold, self.bias, self.heat, self.least = langs, fold, bias, heat, least

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        logits = np.zeros((len(texts), len(self.langs)))
        for i, t in enumerate(texts):
            data, total = _bytes(t), 0
            for k in range(0, len(data), 1 << 20):  # long texts in steps of bounded memory
                part = data[k : k + (1 << 20) + max(GRAMS) - 1]
                for n in GRAMS:
                    if len(part) >= n:
                        b = buckets(part, n)[: 1 << 20]
                        logits[i] += np.bincount(b, minlength=BUCKETS) @ self.fold if len(b) > 2_000 else self.fold[b].sum(0)
                        total += len(b)
            logits[i] /= max(total, 1)
        p = _softmax((logits + self.bias) * self.heat)
        known = np.array([t is not None and LETTER.search(t) is not None for t in texts], bool)
        best = p.argmax(1)
        return [self.langs[k] if ok else "und" for k, ok in zip(best, known)], np.where(known, p.max(1, initial=0), 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_langs: int, rate: float = 30.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding, weights and bias from sparse rows (buckets, shares) by minibatch gradient descent."""
    rng = np.random.default_rng(7)
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.1, (DIM, n_langs)).astype(np.float32), np.zeros(n_langs, np.float32)
    steps = EPOCHS * max(1, -(-len(y) // BATCH))
    for step in range(steps):
        if step % max(1, -(-len(y) // BATCH)) == 0:
            order = rng.permutation(len(y))
        at = order[(step * BATCH) % max(1, len(y)) :][:BATCH]
        dense = np.zeros((len(at), BUCKETS), np.float32)
        for r, i in enumerate(at):
            dense[r, x[i][0]] = x[i][1]
        mean = dense @ e
        p = _softmax(mean @ w + b)
        p[np.arange(len(at)), y[at]] -= 1
        p /= len(at)
        lr = rate * (1 - step / steps)
        back = p @ w.T
        w -= 0.1 * lr * (mean.T @ p)
        b -= 0.01 * lr * p.sum(0)
        e -= lr * (dense.T @ back)
    return e, w, b


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``rows`` of the documents that may be learned from and have a language and a letter."""
    learnable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang is not null and text is not null").where(~_held(F.col("doc_id")))
    drawn = learnable.select("doc_id").distinct().orderBy(F.xxhash64(F.lit("language"), "doc_id"), "doc_id").limit(rows)
    ids = docs.sparkSession.createDataFrame(drawn.toPandas(), "doc_id long")  # ids of the bounded sample

    def sparse(batches):
        for i, texts, langs in rows_of(batches, "doc_id", "text", "lang"):
            for d, t, lang in zip(i, texts, langs):
                if LETTER.search(t):
                    c = counts(t)
                    at = np.flatnonzero(c)
                    yield pa.record_batch([pa.array([d], pa.int64()), pa.array([lang]), pa.array([at.astype("<u2").tobytes()]), pa.array([(c[at] / c.sum()).astype("<f4").tobytes()])], ["doc_id", "lang", "at", "share"])

    once = learnable.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("x")).select("doc_id", "x.*")
    seen = once.mapInArrow(sparse, "doc_id long, lang string, at binary, share binary").toPandas().sort_values(["doc_id", "lang", "share"], ignore_index=True)
    langs = sorted(seen["lang"].unique())
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0)
    x = [(np.frombuffer(a, "<u2"), np.frombuffer(s, "<f4")) for a, s in zip(seen["at"], seen["share"])]
    y = np.searchsorted(langs, seen["lang"])
    kept = np.arange(len(y)) % 10 == 9 if len(y) >= 100 else np.zeros(len(y), bool)
    own = np.flatnonzero(~kept)
    e, w, b = train([x[i] for i in own], y[own], len(langs))
    fold = (e @ w).astype(np.float64)
    test = np.flatnonzero(kept) if kept.any() else own
    z = np.stack([x[i][1].astype(float) @ fold[x[i][0]] for i in test]) + b
    heats = np.geomspace(0.2, 20, 60)
    loss = [-np.log(np.maximum(_softmax(z * h)[np.arange(len(test)), y[test]], 1e-9)).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(z * heat)
    score, right = p.max(1), p.argmax(1) == y[test]
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= WRONG)
    least = float(score[order][fine[-1]]) if len(fine) else 1.0
    return Model(langs, fold, b.astype(float), heat, least)


def _held(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of ``docs``."""

    def work(batches):
        for ids, texts in rows_of(batches, "doc_id", "text"):
            langs, s = model.predict(texts)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(s, pa.float64()), pa.array(s < model.least)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", _held(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
