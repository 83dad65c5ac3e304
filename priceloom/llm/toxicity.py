"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's subwords are its character n-grams with its borders (here: of 3 to 5 bytes); each
has an embedding in a hashed table.  The embeddings of a passage are averaged and go into
a linear softmax over the two classes.  Embeddings and softmax are trained jointly, in
numpy, so misspellings and unseen forms of a word share most of its vectors.

A text is read in passages of ``PASSAGE`` bytes, all of them, and its score is that of its
most toxic passage: one insult in a long text counts as in a short one.  In training the
label of a text is learned on that passage too, and clean texts teach with one further
passage.

Defined cases: NULL and empty texts have the score of an empty passage, as trained; without
training rows, or with rows of one class only, every score is that class's smoothed share;
NULL labels teach nothing; where a document has several labels each teaches; rows that
repeat are treated alike; extra columns pass through, clashing ones are replaced.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_slices

BUCKETS = 1 << 18
DIMS = 8
GRAMS = (3, 4, 5)
PASSAGE = 96
#: Bound of the training sample: so many labelled documents of each class.
SAMPLE = 2500
EPOCHS, RATE = 6, 0.5
#: So many texts' worth of doubt against what a subword seems to say at the start.
SHRINK = 4.0
_PLAIN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)], np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each subword, its passage, first passage of each text and the end) of texts given as bytes.

    A subword has no border inside; borders and everything but letters and digits are blanks.
    A subword belongs to the passage in which it begins.
    """
    sizes = np.diff(offsets)
    # Each text gets a blank on both sides.
    starts = offsets[:-1] + 2 * np.arange(len(sizes)) + 1
    plain = np.full(len(data) + 2 * len(sizes), 32, np.uint8)
    plain[np.arange(len(data)) + 2 * np.repeat(np.arange(len(sizes)), sizes) + 1] = _PLAIN[data]
    passages = np.concatenate([[0], np.cumsum(np.maximum(1, -(-(sizes + 2) // PASSAGE)))])
    owner = np.repeat(np.arange(len(sizes)), sizes + 2)
    passage = passages[owner] + (np.arange(len(plain)) - (starts - 1)[owner]) // PASSAGE
    blank = np.concatenate([[0], np.cumsum(plain == 32)])
    code = plain.astype(np.uint64)
    buckets, at = [], []
    for n in GRAMS:
        if len(plain) < n:
            continue
        many = len(plain) - n + 1
        inner = blank[n - 1:n - 1 + many] - blank[1:1 + many] == 0
        begin = np.flatnonzero(inner)
        h = np.full(len(begin), n, np.uint64)
        for k in range(n):
            h = (h ^ code[begin + k]) * _MIX
            h ^= h >> np.uint64(29)
        buckets.append((h >> np.uint64(40)).astype(np.int64) % BUCKETS)
        at.append(passage[begin])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), passages
    return np.concatenate(buckets), np.concatenate(at), passages


def odds_of(slopes: np.ndarray, bias: float, buckets: np.ndarray, passage: np.ndarray, count: int) -> np.ndarray:
    """Log odds of toxic for each passage: the softmax is linear, so the mean of the embeddings' slopes decides."""
    return np.bincount(passage, slopes[buckets], count) / np.maximum(np.bincount(passage, minlength=count), 1) + bias


class Bag:
    """Embeddings (buckets x dims) and a softmax over (clean, toxic)."""

    def __init__(self):
        self.e = np.zeros((BUCKETS, DIMS), np.float32)
        self.w = np.zeros((DIMS, 2), np.float32)
        self.b = np.zeros(2, np.float32)

    def slopes(self) -> np.ndarray:
        """What each subword adds to the log odds of toxic before averaging."""
        return (self.e @ (self.w[:, 1] - self.w[:, 0])).astype(np.float64)

    def fit(self, texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> None:
        draw = np.random.default_rng(seed)
        share = (float(toxic.sum()) + 1) / (len(toxic) + 2)
        self.b[1] = np.log(share / (1 - share))
        if not len(toxic) or toxic.min() == toxic.max():
            return
        bags = []
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            buckets, passage, ends = subwords(data, np.array([0, len(data)]))
            order = np.argsort(passage, kind="stable")
            bags.append((buckets[order], np.searchsorted(passage[order], np.arange(ends[-1] + 1))))
        # Begin with how much more often a subword occurs in toxic texts than in clean ones; training goes on from there.
        seen = np.zeros((2, BUCKETS))
        for (buckets, _), y in zip(bags, toxic):
            seen[y, np.unique(buckets)] += 1
        rate_of = [toxic.mean(), 1 - toxic.mean()]
        lean = np.log((seen[1] + SHRINK * rate_of[0]) / rate_of[0]) - np.log((seen[0] + SHRINK * rate_of[1]) / rate_of[1])
        self.e[:] = draw.normal(0, 0.01, self.e.shape)
        self.e[:, 0] += lean
        self.w[0] = (-4, 4)
        self.w[1:] = draw.normal(0, 0.1, (DIMS - 1, 2))
        odds = [self._passages(self.slopes(), bag).max() for bag in bags]
        self.b[1] = -float(np.median(np.array(odds)[toxic == 1]) + np.median(np.array(odds)[toxic == 0])) / 2
        self.b[0] = 0
        weight = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
        for epoch in range(epochs):
            slopes, pace = self.slopes(), rate * (1 - epoch / epochs)
            for k in draw.permutation(len(bags)):
                odds = self._passages(slopes, bags[k])
                chosen = {int(odds.argmax())} | (set() if toxic[k] else {int(draw.integers(len(odds)))})
                for j in chosen:
                    own = bags[k][0][bags[k][1][j]:bags[k][1][j + 1]]
                    mean = self.e[own].mean(axis=0) if len(own) else np.zeros(DIMS, np.float32)
                    z = mean @ self.w + self.b
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    err = (p - np.eye(2)[toxic[k]]) * weight[k]
                    if len(own):
                        back = (self.w @ err).astype(np.float32)
                        np.subtract.at(self.e, own, pace * back / len(own))
                        slopes[own] = self.e[own] @ (self.w[:, 1] - self.w[:, 0])
                        self.w -= (0.02 * pace * np.outer(mean, err)).astype(np.float32)
                    self.b -= (0.1 * pace * err).astype(np.float32)

    def _passages(self, slopes: np.ndarray, bag) -> np.ndarray:
        buckets, ends = bag
        upto = np.concatenate([[0.0], np.cumsum(slopes[buckets])])
        return (upto[ends[1:]] - upto[ends[:-1]]) / np.maximum(np.diff(ends), 1) + float(self.b[1] - self.b[0])


def train(labelled: DataFrame, sample: int = SAMPLE) -> Bag:
    """From labelled (text, toxic 0 or 1): so many of each class, those with the smallest hashes."""
    c = F.col
    texts, toxic = [], []
    for y in (0, 1):
        rows = labelled.filter(c("toxic") == y).select("text", F.xxhash64("text").alias("h")).orderBy("h", "text").limit(sample).collect()
        texts += [r["text"] or "" for r in rows]
        toxic += [y] * len(rows)
    bag = Bag()
    bag.fit(texts, np.array(toxic, int))
    return bag


def predict(docs: DataFrame, bag: Bag) -> DataFrame:
    """docs with ``score`` and ``predicted``, from the whole text."""
    held = docs.drop("score", "predicted").withColumns({"score": F.lit(None).cast("double"), "predicted": F.lit(None).cast("int")})
    sent = held.sparkSession.sparkContext.broadcast((bag.slopes(), float(bag.b[1] - bag.b[0])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slopes, bias = sent.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            score = np.empty(len(text))
            for first, last, data, offsets in text_slices(text, 1 << 19):
                buckets, passage, ends = subwords(data, offsets)
                odds = np.maximum.reduceat(odds_of(slopes, bias, buckets, passage, int(ends[-1])), ends[:-1])
                score[first:last] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            for name, values in (("score", pa.array(score, pa.float64())), ("predicted", pa.array((score >= 0.5).astype(np.int32), pa.int32()))):
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, batch.schema.field(at), values)
            yield batch

    return held.mapInArrow(scan, held.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What may be learned from: (text, toxic)."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return docs.select("doc_id", "text").join(known.select("doc_id", "toxic"), "doc_id").select("text", "toxic")


def sampled_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The labels of at most ``sample`` documents of each class, those with the smallest hashes of their ids."""
    c = F.col
    known = labels.filter(c("toxic").isin(0, 1) & c("doc_id").isNotNull() & ~held_out(c("doc_id"))).select("doc_id", "toxic")
    parts = [known.filter(c("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The sample is bounded, so only its texts are looked up.
    bag = train(labelled(docs, F.broadcast(sampled_labels(table(spark, sf_dir, "labels")))))
    return predict(docs, bag).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
