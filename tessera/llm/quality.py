"""Quality classifier: supervised subword embeddings.

Features of a text are its words, pairs of neighbouring words (one more for a pair of equal words), and character n-grams (3 and 4 bytes) of words with
their borders, hashed into BUCKETS. Each bucket has a learned vector; a document's vector is the average over all its
features, a softmax of its product with the output matrix is the score. Vectors and output matrix are trained
by stochastic gradient descent in numpy, on at most TRAIN_ROWS labelled documents and TRAIN_BYTES of text (a documented bound of the
fit only): those with the least hashes of their ids, whole texts. Everything else covers all rows and whole texts.

Scoring needs only one number per bucket, its vector times the difference of the two output columns, so a
document's score is a mean over a table lookup: executors get 4 bytes a bucket, whatever the data.

A text without words (empty, null, white space) gets the prior of the training labels. Null labels are left out;
several labels of one document count as their maximum. If no usable label is there, all scores are 0.5.
A very long text is scored by all its features, like any other. Repeated rows are scored each. Empty tables give no rows.
A null doc_id is not held out (its remainder is unknown) and never trained on. Extra columns pass through `score`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import shared, words

#: Documents to fit on at most; buckets; numbers of a vector; passes over the documents; step size.
TRAIN_ROWS, BUCKETS, DIM, EPOCHS, RATE = 4000, 1 << 18, 8, 6, 0.3
#: Bytes of texts to fit on at most (whole texts, in order of their hashes).
TRAIN_BYTES = 64 << 20
GRAMS = (3, 4)
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def features(w: words.Words, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row of the slice) of all features, in a few arrays whose rows ascend."""
    if not len(w):
        return
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    h = w.hashes()
    yield (words.mix(h ^ _SEEDS[0]) >> shift).astype(np.int32), w.doc
    pair = words.windows(h, 2)
    inside = words.same_row(w.doc, 2)
    yield (words.mix(pair[inside] ^ _SEEDS[1]) >> shift).astype(np.int32), w.doc[:-1][inside]
    # a word that follows itself, whatever it is, is a pair of one kind
    again = (h[1:] == h[:-1]) & inside
    yield np.zeros(int(again.sum()), dtype=np.int32), w.doc[1:][again]
    # the byte after a word is a space; with the one before it, n-grams show a word's borders
    text = np.concatenate([np.array([0x20], dtype=np.uint8), w.text])
    owner = np.repeat(w.doc, w.ends - w.starts + 1)
    wide = text.astype(np.uint32)
    three = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    gap = text == 0x20
    for n, seed in zip(GRAMS, _SEEDS[2:], strict=True):
        gram = three if n == 3 else three[:-1] | wide[3:] << np.uint32(24)
        within = ~gap[1 : len(gram) + 1]
        for k in range(2, n - 1):
            within &= ~gap[k : len(gram) + k]
        code = (gram * np.uint32(int(seed) & 0xFFFFFFFF | 1)) ^ (gram >> np.uint32(15))
        code = code * np.uint32(0x2C1B3C6D | 1)
        yield (code[within] >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int32), owner[: len(gram)][within]


@dataclass
class Model:
    """A number per bucket, and the offset: score = sigmoid(offset + mean of the numbers of a text's features)."""

    table: np.ndarray
    offset: float
    prior: float


def _bag(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    found = [b for b, _ in features(words.split([(text or "").encode()]), buckets)]
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32)
    values, n = np.unique(np.concatenate(found), return_counts=True)
    return values, (n / n.sum()).astype(np.float32)


def fit(rows: list[tuple[str | None, int]], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Trains on (text, label 0 or 1)."""
    prior = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    bags = [(b, y) for b, y in ((_bag(x, buckets), y) for x, y in rows) if len(b[0])]
    if not bags or len({y for _, y in rows}) < 2:
        return Model(np.zeros(buckets, dtype=np.float32), float(np.log(prior / (1 - prior))), prior)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    total, step = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            (bucket, share), y = bags[i]
            lr = rate * (1 - step / total)
            step += 1
            own = vectors[bucket]
            mean = share @ own
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * p
            # a document's features share one gradient; large documents move each of theirs as far as small ones
            vectors[bucket] = own - lr * len(bucket) ** 0.5 * np.outer(share, back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs, with score (double, 0 to 1); a column of that name is replaced."""
    shared.lean(docs.sparkSession)
    docs = docs.drop("score")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        buckets = len(m.table)
        for batch in batches:
            out = []
            for _, texts in words.slices(batch.column("text"), 1 << 19):
                w = words.split(texts)
                total, n = np.zeros(len(texts)), np.zeros(len(texts))
                for bucket, row in features(w, buckets):
                    total += np.bincount(row, m.table[bucket], len(texts))
                    n += np.bincount(row, minlength=len(texts))
                p = 1 / (1 + np.exp(-(m.offset + total / np.maximum(n, 1))))
                out.append(np.where(n > 0, p, m.prior))
            scores = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], [*names, "score"])

    return docs.mapInArrow(apply, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Model:
    """Fits on at most so many labelled documents, and bytes of texts, that are not held out; texts of more than a sixteenth of these bytes are not
    among them, so that no few texts take the place of all others. docs may be a part of all documents."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("quality").cast("int").alias("__y"))
    order = F.xxhash64("__id")
    chosen = F.broadcast(known.orderBy(order, "__id").limit(rows))
    found = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most // 16).select(F.col("doc_id").cast("long").alias("__id"), "text").join(chosen, "__id").orderBy(order, "__id", "text").limit(rows)
    # a window over at most `rows` rows
    sums = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(order, "__id", "text").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("__sum", sums).where(F.col("__sum") <= most)
    return fit([(r[0], r[1]) for r in found.select("text", "__y").toLocalIterator()])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted (1 if score >= 0.5)."""
    rows = score(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
