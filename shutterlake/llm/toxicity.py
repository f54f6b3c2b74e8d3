"""Toxicity classifier: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, word pairs and pairs with one word between, hashed to 2^BITS weights;
words are runs of letters and digits, A-Z lower-cased.  FTRL-proximal (McMahan et al., 2013) gives every
coordinate its own learning rate and sets weights that bring little to exactly zero, so the model is a
short list of (index, weight): at most 2^BITS entries, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import LOWER, WORDLIKE, Rolling, combine, crc_bucket, documents, mix, text_chunks, words

BITS = 20
# Bounds of the training sample: so many labelled documents of either class at most.
TOXIC, CLEAN = 3_000, 9_000


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    epochs: int = 3
    toxic: int = TOXIC
    clean: int = CLEAN


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature indexes of a run of texts, and where each text's start."""
    data = LOWER[data]
    starts, ends, first = words(data, at, WORDLIKE)
    h = Rolling(data).spans(starts, ends)
    n = len(h)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    pairs = combine(h, 2)
    skips = mix(h[:-2] * np.uint64(3) + h[2:] * np.uint64(0x9E3779B97F4A7C15)) if n > 2 else np.zeros(0, np.uint64)
    in_pair, in_skip = doc[:-1] == doc[1:], doc[:-2] == doc[2:]
    owner = np.concatenate([doc, doc[:-1][in_pair], doc[:-2][in_skip]])
    index = (np.concatenate([h, pairs[in_pair] if n > 1 else pairs, skips[in_skip] if n > 2 else skips]) >> np.uint64(64 - BITS)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return index[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at) - 1))]).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, p: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (index, value) and bias of FTRL-proximal over documents given by their distinct features."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    total = len(labels)
    prior = (labels.sum() + 0.5) / (total + 1.0)
    bias = float(np.log(prior / (1 - prior)))
    order = np.random.default_rng(7)
    for _ in range(p.epochs if 0 < labels.sum() < total else 0):
        for k in order.permutation(total):
            i = rows[k]
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - labels[k]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
            bias -= 0.01 * g
    w = np.where(np.abs(z) <= p.l1, 0.0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    used = np.flatnonzero(w)
    return used.astype(np.int32), w[used].astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on a bounded sample: of each class the labelled documents with the least hash of doc_id.

    The sample may hold toxic documents in another share than the labels do; the bias is shifted by the
    difference of the two log-odds.  `labels` has doc_id and toxic; rows with a null in either teach
    nothing, and a document with several labels counts as toxic if one says so.  Without both classes the
    model is the prior alone.
    """
    known = labels.filter("doc_id is not null and toxic is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    known = known.filter("_toxic in (0, 1)")
    count = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = (p.clean, p.toxic)
    pick = [known.filter(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(most[c]) for c in (0, 1)]
    odds = [(count.get(1, 0) + 0.5) / (count.get(0, 0) + 0.5), (min(count.get(1, 0), p.toxic) + 0.5) / (min(count.get(0, 0), p.clean) + 0.5)]
    shift = float(np.log(odds[0] / odds[1]))
    sample = documents(docs).join(F.broadcast(pick[0].unionByName(pick[1])), F.col("doc_id") == F.col("_id")).select("_toxic", "text", F.xxhash64("doc_id").alias("_order"))

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by("_order").combine_chunks()
        rows: list[np.ndarray] = []
        for batch in group.to_batches():
            for _, _, data, at in text_chunks(batch):
                index, start = features(data, at)
                rows += [np.unique(index[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
        index, weight, bias = fit(rows, group["_toxic"].to_numpy().astype(float), p)
        return pa.table([pa.array([index.tobytes()]), pa.array([weight.tobytes()]), pa.array([bias])], ["index", "weight", "bias"])

    model = sample.groupBy(F.lit(1).alias("all")).applyInArrow(learn, "index binary, weight binary, bias double").first()
    if model is None:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), -5.0
    return np.frombuffer(model["index"], np.int32), np.frombuffer(model["weight"], np.float32), model["bias"] + shift


def margins(data: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the weights of each text's distinct features."""
    found, start = features(data, at)
    used = w[found] != 0  # most features have no weight
    doc = np.repeat(np.arange(len(at) - 1), np.diff(start))[used]
    pairs = np.unique(doc.astype(np.int64) << BITS | found[used])
    return np.bincount(pairs >> BITS, w[pairs & ((1 << BITS) - 1)], len(at) - 1)


def probabilities(batch: pa.RecordBatch, w: np.ndarray, bias: float) -> np.ndarray:
    margin = np.full(batch.num_rows, bias)
    for lo, hi, data, at in text_chunks(batch):
        margin[lo:hi] += margins(data, at, w)
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))


def dense(model: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    w = np.zeros(1 << BITS, np.float32)
    w[model[0]] = model[1]
    return w


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """`doc_id` and `score` (0 to 1) of every row, from its whole text; null and empty texts get the prior."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = dense(sent.value), sent.value[2]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probabilities(batch, w, bias))], ["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), threshold: float = 0.3) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` for every row.

    Labels of held-out documents (crc32 of doc_id modulo 4 is 2) are never learnt from.  A row without
    doc_id is scored like any other and not held out.  An empty table gives no rows.
    """
    model = train(docs, labels.filter(crc_bucket("doc_id", 4) != 2), p)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with all their columns.

    Scores come from the row's own text, so they are joined to nothing: the filter reads the rows once.
    """
    model = train(docs, labels.filter(crc_bucket("doc_id", 4) != 2), p)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = dense(sent.value), sent.value[2]
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch, w, bias) < threshold))

    return docs.mapInArrow(run, schema)
