"""Small tables and plain re-implementations that the corpus operators are held against."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import DataFrame, SparkSession

WORDS = "alpha beta gamma delta river stone cloud maple harbor velvet copper lantern meadow orbit puzzle quartz ribbon saddle timber walnut".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(300)) for _ in range(n))


def docs(spark: SparkSession, rows: list[tuple], parts: int = 3) -> DataFrame:
    """(doc_id, text[, lang[, source]]) rows, with further columns whose names operators use inside."""
    filled = [(*r, *[None] * (4 - len(r)), 1, "x", "y") for r in rows]
    return spark.createDataFrame(filled, "doc_id long, text string, lang string, source string, n int, digest string, keep_id string").repartition(parts)


def by_id(df: DataFrame) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def word_set(text: str | None, k: int = 4) -> set:
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(sets: dict, percent: int = 85) -> dict:
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def repeats(texts: dict[int, str | None], length: int = 400) -> dict:
    """(n_bytes, n_removed, n_spans, sha256 of the rest) by a dictionary of all strings of `length` bytes."""
    raw = {i: (t or "").encode() for i, t in texts.items()}
    count: dict[bytes, int] = {}
    for b in raw.values():
        for p in range(len(b) - length + 1):
            key = hashlib.md5(b[p : p + length]).digest()
            count[key] = count.get(key, 0) + 1
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[hashlib.md5(b[p : p + length]).digest()] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def repeated_words(texts: dict[int, str | None], run: int = 51) -> dict:
    """How many words of each text lie in runs of `run` words that another text has, too."""
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in texts.items()}
    where: dict[tuple, set] = {}
    for i, w in split.items():
        for p in range(len(w) - run + 1):
            where.setdefault(tuple(w[p : p + run]), set()).add(i)
    out = {}
    for i, w in split.items():
        hit = {q for p in range(len(w) - run + 1) if len(where[tuple(w[p : p + run])]) > 1 for q in range(p, p + run)}
        out[i] = len(hit)
    return out
