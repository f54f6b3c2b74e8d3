"""Language identification with error-correcting output codes.

Every language has a codeword; one binary logistic classifier per bit tells, from byte n-grams, which of two
sets of languages a text is in (Dietterich and Bakiri, 1995).  The language whose codeword the margins fit
with the least logistic loss wins (loss-weighted decoding; Allwein, Schapire, Singer, 2000).  If the second is
close behind, the text is flagged as ambiguous.

The model is 2^BITS weights for each bit, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import LOWER, crc_bucket, documents, text_chunks

BITS = 14
ORDERS = (1, 2, 3)
# Weight of each n-gram's share, so that orders count alike.
SCALE = 60.0
# Margins are halved for a text of so many bytes, and less for longer ones: short texts tell less.
SHORT = 40
_MULTIPLIER = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Ecoc:
    """`sample`: bound of the training sample's expected size, shared evenly by the languages."""

    sample: int = 4_000
    epochs: int = 6
    rate: float = 0.5
    l2: float = 1e-5
    close: float = 0.2


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of `n` languages.

    Up to five languages get the exhaustive code; more get the random code of about 10 log2 n bits whose
    least distance is the best of 200.
    """
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= 5:
        bits = np.arange(1, 2 ** (n - 1))
        return np.array([1 - 2 * ((bits << 1 >> k) & 1) for k in range(n)])
    rng, best, most = np.random.default_rng(5), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = min(int((code[i] != code[:i]).sum(axis=1).min()) for i in range(1, n))
        if least > most:
            best, most = code, least
    return best


# Letters of ASCII in lower case and bytes of other characters; everything else reads as a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed n-grams of a run of texts (none crosses texts), and where each text's start."""
    folded = _FOLD[data].astype(np.uint32)
    size = np.diff(at)
    for n in ORDERS:
        code = np.full(max(len(folded) - n + 1, 0), np.uint32(n), np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | folded[k : k + len(code)]
        index = ((code * _MULTIPLIER) >> np.uint32(32 - BITS)).astype(np.int32)
        count = np.maximum(size - n + 1, 0)
        start = np.concatenate([[0], np.cumsum(count)])
        inside = np.repeat(at[:-1] - start[:-1], count) + np.arange(start[-1])
        yield index[inside] if len(inside) != len(index) else index, start


def margins(data: np.ndarray, at: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A row of bit margins for each text."""
    out = np.tile(bias, (len(at) - 1, 1))
    for index, start in grams(data, at):
        filled = np.flatnonzero(np.diff(start))
        if len(filled):
            for b in range(weights.shape[1]):
                sums = np.add.reduceat(weights[:, b][index], start[filled])
                out[filled, b] += SCALE * sums / np.diff(start)[filled]
    return out


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, code: np.ndarray, p: Ecoc) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the bits' classifiers by AdaGrad; a text is its n-gram indexes and their shares."""
    bits = code.shape[1]
    w, g2 = np.zeros((1 << BITS, bits)), np.full((1 << BITS, bits), 1e-6)
    bias, b2 = np.zeros(bits), np.full(bits, 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(p.epochs):
        for i in rng.permutation(len(texts)):
            index, value = texts[i]
            y = code[labels[i]]
            m = value @ w[index] + bias
            g = -y / (1.0 + np.exp(np.clip(y * m, -30, 30)))
            step = value[:, None] * g + p.l2 * w[index]
            g2[index] += step * step
            w[index] -= p.rate * step / np.sqrt(g2[index])
            b2 += g * g
            bias -= p.rate * g / np.sqrt(b2)
    return w.astype(np.float32), bias.astype(np.float32)


Model = tuple[list, np.ndarray, np.ndarray, np.ndarray]


def train(docs: DataFrame, p: Ecoc = Ecoc()) -> Model | None:
    """Languages, codewords, weights, biases, learnt from `text` and `lang`; None without a labelled text.

    Rows without lang or text teach nothing.  A row is in the sample if a hash of its doc_id is below its
    language's rate, which is set so that languages are about equally many.
    """
    rows = documents(docs, F.col("lang").cast("string").alias("_lang")).filter("_lang is not null and text is not null")
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    each = p.sample / len(langs)
    spark = docs.sparkSession
    rates = spark.createDataFrame([(c, k, min(1.0, each / counts[c])) for k, c in enumerate(langs)], "_lang string, _class int, _rate double")
    # Rows without an id are drawn by their text, so that they are not drawn or left all together.
    hashed = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit("sample"))).otherwise(F.xxhash64("doc_id", F.lit("sample")))
    place = F.pmod(hashed, F.lit(1 << 30)) / (1 << 30)
    sample = rows.join(F.broadcast(rates), "_lang").filter(place < F.col("_rate")).select("_class", "text", F.xxhash64("doc_id", "text").alias("_order"))
    code = codewords(len(langs))

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by("_order").combine_chunks()
        texts = []
        for batch in group.to_batches():
            for lo, hi, data, at in text_chunks(batch):
                parts: list[list] = [[] for _ in range(hi - lo)]
                for index, start in grams(data, at):
                    for t, (a, b) in enumerate(zip(start[:-1], start[1:], strict=True)):
                        i, n = np.unique(index[a:b], return_counts=True)
                        parts[t].append((i, SCALE * n / max(b - a, 1)))
                texts += [(np.concatenate([i for i, _ in x]), np.concatenate([v for _, v in x])) for x in parts]
        w, bias = fit(texts, group["_class"].to_numpy(), code, p)
        return pa.table([pa.array([w.tobytes()]), pa.array([bias.tobytes()])], ["weights", "bias"])

    model = sample.groupBy(F.lit(1).alias("all")).applyInArrow(learn, "weights binary, bias binary").first()
    if model is None:
        return None
    bits = code.shape[1]
    return langs, code, np.frombuffer(model["weights"], np.float32).reshape(-1, bits), np.frombuffer(model["bias"], np.float32)


def decode(m: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row of margins, and each codeword's probability from its loss."""
    loss = np.logaddexp(0.0, -m[:, None, :] * code[None, :, :]).sum(axis=2)
    fit_ = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share = fit_ / fit_.sum(axis=1, keepdims=True)
    return share.argmax(axis=1), share


def has_letter(texts: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    letters = np.concatenate([np.zeros(1, np.int64), np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122))])
    out = letters[at[1:]] > letters[at[:-1]]
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def language(docs: DataFrame, train_on: DataFrame | None = None, p: Ecoc = Ecoc()) -> DataFrame:
    """One row per input row: `doc_id`, `lang_pred`, `score` (0 to 1), `ambiguous`.

    `train_on` has doc_id, text and lang; by default `docs` itself.  Null texts and texts without a letter,
    empty ones among them, are `und` with score 0, and so is everything if there is nothing to learn from.
    With one language to learn, every other text is given it.  An empty table gives no rows.
    """
    model = train(docs if train_on is None else train_on, p)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    close = p.close

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, unsure = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if sent.value is not None:
                langs, code, w, bias = sent.value
                w = np.asfortranarray(w)
                for lo, hi, data, at in text_chunks(batch, most=1 << 20):
                    n_bytes = np.diff(at)
                    best, share = decode(margins(data, at, w, bias) * (n_bytes / (n_bytes + SHORT))[:, None], code)
                    known = has_letter(batch.column("text").slice(lo, hi - lo), data, at)
                    top = share[np.arange(hi - lo), best]
                    second = np.partition(share, -2, axis=1)[:, -2] if len(langs) > 1 else np.zeros(hi - lo)
                    for i in np.flatnonzero(known):
                        names[lo + i] = langs[best[i]]
                    score[lo:hi] = np.where(known, top, 0.0)
                    unsure[lo:hi] = known & (top - second < close)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return documents(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def language_held_out(docs: DataFrame, p: Ecoc = Ecoc()) -> DataFrame:
    """`language` for all rows, learnt only from rows whose crc32 of doc_id modulo 5 is not 0; adds `held_out`."""
    out = language(docs, docs.filter(crc_bucket("doc_id", 5) != 0), p)
    return out.select("doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
