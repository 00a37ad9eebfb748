"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax on top."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 4)
EPOCHS = 5
RATE = 12.0
MINIBATCH = 32
SEED = 11
# The model is fitted on at most this many labelled rows, those with the smallest hashed ids.
SAMPLE = 2000
# Texts are read in groups of about this many bytes, so a task never holds the words of a whole batch.
GROUP_BYTES = 2 << 20

# The bucket of a word that repeats the word before it: the one word bigram that needs no vocabulary.
REPEAT = 0

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    """What scoring needs of a fitted model: each bucket's pull towards label 1, and the bias."""

    pull: np.ndarray
    bias: float
    empty: float


def text_groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    """UTF-8 bytes of the texts, a null as b'', in runs of about ``limit`` bytes."""
    group, held = [], 0
    for value in column.cast(pa.binary()):
        text = value.as_py() or b""
        group.append(text)
        held += len(text)
        if held >= limit:
            yield group
            group, held = [], 0
    if group:
        yield group


def coded_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word its number among the distinct words; the distinct words; words per text. A-Z are lower-cased."""
    parts = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for words in parts for w in words]
    codes, distinct = pd.factorize(flat)
    return codes, distinct, counts


def word_features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(word number, bucket)`` of every feature: the word itself and its character n-grams with both ends marked."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    owner, hashed = [np.arange(n)], [pd.util.hash_array(words, categorize=False)]
    marked = ["<" + w.decode("utf-8", "replace") + ">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, n)
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of_char = np.repeat(np.arange(n), sizes)
    for size in NGRAMS:
        if len(chars) < size:
            continue
        rolled = np.full(len(chars) - size + 1, size, np.uint64)
        for step in range(size):
            rolled = (rolled ^ chars[step:len(chars) - size + 1 + step]) * _MIX
            rolled ^= rolled >> np.uint64(29)
        inside = of_char[:len(rolled)] == of_char[size - 1:]
        owner.append(of_char[:len(rolled)][inside])
        hashed.append(rolled[inside])
    buckets = (np.concatenate(hashed) >> np.uint64(20)) % np.uint64(BUCKETS)
    return np.concatenate(owner), buckets.astype(np.int64)


def repeats(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text how many of its words repeat the word before."""
    of_text = np.repeat(np.arange(len(counts)), counts)
    again = (codes[1:] == codes[:-1]) & (of_text[1:] == of_text[:-1])
    return np.bincount(of_text[1:][again], minlength=len(counts)).astype(np.float64)


def sparse_rows(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its buckets and their shares of all its features."""
    rows = []
    for text in texts:
        codes, distinct, counts = coded_words([text])
        owner, bucket = word_features(distinct)
        weight = np.bincount(codes, minlength=len(distinct))[owner].astype(np.float64)
        total = np.bincount(bucket, weight, BUCKETS) if len(bucket) else np.zeros(BUCKETS)
        total[REPEAT] += repeats(codes, counts)[0]
        used = np.flatnonzero(total)
        rows.append((used, total[used] / max(total.sum(), 1.0)))
    return rows


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """Stochastic gradient descent on the softmax loss, the rate falling linearly to zero.

    Rows with one label only, or none, give a constant model: the smoothed share of label 1.
    """
    labels = np.asarray(labels, np.int64)
    prior = (labels.sum() + 1) / (len(labels) + 2)
    base = float(np.log(prior / (1 - prior)))
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(BUCKETS), base, base)
    rows = sparse_rows(texts)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    output, bias = np.zeros((DIM, 2)), np.zeros(2)
    steps, step = EPOCHS * -(-len(rows) // MINIBATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), MINIBATCH):
            chosen = order[at:at + MINIBATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            index = np.concatenate([rows[i][0] for i in chosen])
            share = np.concatenate([rows[i][1] for i in chosen])
            of_row = np.repeat(np.arange(len(chosen)), [len(rows[i][0]) for i in chosen])
            mean = np.zeros((len(chosen), DIM))
            np.add.at(mean, of_row, vectors[index] * share[:, None])
            logits = mean @ output + bias
            odds = np.exp(logits - logits.max(1, keepdims=True))
            error = odds / odds.sum(1, keepdims=True)
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            error /= len(chosen)
            back = error @ output.T
            output -= rate * mean.T @ error
            bias -= rate * 0.1 * error.sum(0)
            # a bucket's gradient is tiny beside the output's, for a document spreads over hundreds of buckets
            np.add.at(vectors, index, -rate * len(chosen) * back[of_row] * share[:, None])
    pull = vectors @ (output[:, 1] - output[:, 0])
    return Model(pull, float(bias[1] - bias[0]), base)


def logits_of(texts: list[bytes], model: Model) -> np.ndarray:
    codes, distinct, counts = coded_words(texts)
    owner, bucket = word_features(distinct)
    pull = np.bincount(owner, model.pull[bucket], len(distinct))
    features = np.bincount(owner, minlength=len(distinct)).astype(np.float64)
    of_text = np.repeat(np.arange(len(texts)), counts)
    again = repeats(codes, counts)
    total = np.bincount(of_text, pull[codes], len(texts)) + again * model.pull[REPEAT]
    size = np.bincount(of_text, features[codes], len(texts)) + again
    return np.where(size > 0, total / np.maximum(size, 1) + model.bias, model.empty)


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """``(label, id, text)`` of at most ``sample`` labelled ids outside the held-out third, one row each: of several labels the
    least, of several texts the first in order."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    chosen = (labels.filter(F.col(label).isin(0, 1) & (fold != 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("_y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    labelled = docs.select("doc_id", "text").join(small_side(chosen, "labelled"), "doc_id")
    return labelled.groupBy("_y", "doc_id").agg(F.min("text").alias("text"))


def train(rows: DataFrame) -> Model:
    """Fit in one task on the bounded sample; the driver gets one number per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(y, i, t or b"") for b in batches
                for y, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist())]
        held.sort(key=lambda r: (r[1], r[2]))
        model = fit([t for _, _, t in held], np.array([y for y, _, _ in held], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([model.pull.astype("<f8").tobytes()]), pa.array([model.bias]),
                                          pa.array([model.empty])], names=["pull", "bias", "empty"])

    row = rows.repartition(1).mapInArrow(run, "pull binary, bias double, empty double").head()
    if row is None:
        return Model(np.zeros(BUCKETS), 0.0, 0.0)
    return Model(np.frombuffer(row.pull, "<f8"), row.bias, row.empty)


def score_documents(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``: the probability of label 1, from the whole text alone.

    Null and empty texts, and texts without words, get the share of label 1 among the training rows. Repeated
    rows score alike. A column already called ``name`` is replaced.
    """
    docs = docs.drop(name) if name in docs.columns else docs
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = [logits_of(group, model) for group in text_groups(batch.column(batch.schema.get_field_index(text)))]
            values = 1 / (1 + np.exp(-np.clip(np.concatenate(logits) if logits else np.empty(0), -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*batch.schema.names, name])

    return docs.mapInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row; without usable labels every score is one half."""
    model = train(training_rows(docs, labels, sample=sample))
    scored = score_documents(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
