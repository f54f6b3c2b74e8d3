"""Removal of long repeated byte strings, by a difference-cover sample and blockwise sorting of suffixes.

Two places repeat if the `length` bytes (400) from them on are equal.  Sorting all suffixes to that depth
would need every place of the corpus at once, so most are settled before:

1. Anchors.  In every string of 400 bytes the place with the least hash of its next 64 bytes is an anchor
   (ties: all of them).  Equal strings have equal anchors, so a string none of whose anchors occurs
   again does not repeat.  About one place in 170 is an anchor.
2. Cover sample.  Of the strings that are left, places whose position modulo 73 is in a difference cover are
   ranked by the 328 bytes that follow (only equality of ranks matters here).  For any two positions a shift
   below 73 moves both onto the cover; so two equal strings hold, at the same offset, two sample places of
   equal rank, and a string without a repeated rank does not repeat.
3. Suffix buckets.  The suffixes that are left are dealt into buckets by a 64-bit fingerprint of their 400
   bytes and every bucket is sorted by it, one at a time in a task; equal neighbours repeat.

Steps 1 and 2 lose no repeat.  Step 3 could only err by a collision of fingerprints.  Equal whole texts are
known by their SHA-256 before: one of them takes part.

A passage of over 50 words can be shorter than 400 bytes.  So the same steps also tell how many words of a
text lie in runs of 51 words that occur in another text; nothing is removed for them.  Step 1 takes their
anchors by the hashes of 16 words, step 2 the 51 words themselves, where the least anchor occurs elsewhere.
Each text sends a key once, so that what repeats only within it does not count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Rolling, combine, documents, materialise, repeated_keys, text_chunks, unpack, words
from shutterlake.session import drop_path, fresh_path

LENGTH = 400
ANCHOR = 64
PERIOD = 73
# A perfect difference set modulo 73; every other residue is a difference of two of them once.
COVER = (0, 1, 3, 7, 15, 31, 36, 54, 63)
_ON_COVER = np.isin(np.arange(PERIOD), COVER)
RUN = 51  # words
GRAM = 16
# Bytes of RUN words at least, with white space between; and what marks the place of a word among the places of bytes.
LEAST = 2 * RUN - 1
WORD = np.uint32(1 << 31)


def sliding(values: np.ndarray, width: int, pick: np.ufunc, rest: int) -> np.ndarray:
    """`pick` (minimum or maximum) over each `width` neighbours, from running values of blocks of that width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, rest, values.dtype)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = pick.accumulate(grid, axis=1).ravel()
    back = pick.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Which values are the least of some `width` neighbours."""
    if len(h) < width:
        return np.zeros(len(h), bool)
    least = np.zeros(len(h) + width - 1, h.dtype)
    least[width - 1 : len(h)] = sliding(h, width, np.minimum, np.iinfo(h.dtype).max)
    return sliding(least, width, np.maximum, 0) == h


def once(docs: np.ndarray, places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every key of a document at its first place, which is marked as that of a word."""
    order = np.lexsort((places, keys, docs))
    docs, places, keys = docs[order], places[order], keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return docs[first], places[first].astype(np.uint32) | WORD, keys[first]


def byte_and_word(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The places of bytes and those of words."""
    both = unpack(found, np.uint32)[0]
    word = both >= WORD
    return both[~word].astype(np.int64), (both[word] ^ WORD).astype(np.int64)


def grams(word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of GRAM words at every word, and the part of them that anchors are chosen by."""
    h = combine(word_hashes, GRAM)
    return h, (h >> np.uint64(32)).astype(np.uint32)


def anchor_keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids = batch.column("doc_id").to_numpy()
    for lo, hi, data, at in text_chunks(batch):
        if len(data) < LEAST:
            continue
        rolling = Rolling(data)
        starts, ends, first = words(data, at)
        if len(starts) >= RUN:
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            h, short = grams(rolling.spans(starts, ends))
            inside = doc[: len(h)] == doc[GRAM - 1 :]
            short[~inside] = np.iinfo(np.uint32).max
            chosen = np.flatnonzero(anchors(short, RUN - GRAM + 1) & inside)
            chosen = chosen[n[doc[chosen]] >= RUN]
            doc, place, keys = once(doc[chosen], chosen - first[doc[chosen]], h[chosen])
            yield ids[lo:hi][doc], place, keys
        if len(data) < LENGTH:
            continue
        size = np.diff(at)
        place = np.arange(len(data) - ANCHOR + 1)
        end = np.repeat(at[1:], size)[: len(place)]
        h = rolling.spans(place, place + ANCHOR)
        short = (h >> np.uint64(32)).astype(np.uint32)
        short[place + ANCHOR > end] = np.iinfo(np.uint32).max
        chosen = np.flatnonzero(anchors(short, LENGTH - ANCHOR + 1) & (place + ANCHOR <= end))
        doc = np.searchsorted(at, chosen, "right") - 1
        inside = size[doc] >= LENGTH
        chosen, doc = chosen[inside], doc[inside]
        yield ids[lo:hi][doc], chosen - at[doc], h[chosen]


def starts_near(place: np.ndarray, before: int, n: int) -> np.ndarray:
    """Mask of the starts of strings of LENGTH in a text of `n` bytes, of which a found place is at most `before` behind."""
    change = np.zeros(n + 2, np.int32)
    np.add.at(change, np.maximum(place - before, 0), 1)
    np.add.at(change, np.minimum(place, n) + 1, -1)
    return np.cumsum(change[: max(n - LENGTH + 1, 0)]) > 0


def cover_keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids, found = batch.column("doc_id").to_numpy(), batch.column("found")
    rank = LENGTH - PERIOD + 1
    for lo, _, data, at in text_chunks(batch):
        rolling = Rolling(data)
        starts, ends, first = words(data, at)
        hashes = rolling.spans(starts, ends)
        for t in range(len(at) - 1):
            n = int(at[t + 1] - at[t])
            near, anchored = byte_and_word(found[lo + t].as_py())
            own = hashes[first[t] : first[t + 1]]
            if len(anchored) and len(own) >= RUN:
                short = grams(own)[1]
                anchored = anchored[anchored < len(short)]
                place = np.flatnonzero(np.isin(sliding(short, RUN - GRAM + 1, np.minimum, np.iinfo(np.uint32).max), short[anchored]))
                yield once(np.full(len(place), ids[lo + t]), place, combine(own, RUN)[place])
            start = starts_near(near, LENGTH - ANCHOR, n)
            if not start.any():
                continue
            reach = np.zeros(n + PERIOD, np.int32)
            s = np.flatnonzero(start)
            np.add.at(reach, s, 1)
            np.add.at(reach, s + PERIOD, -1)
            place = np.flatnonzero(np.cumsum(reach[: n - rank + 1]) > 0)
            place = place[_ON_COVER[place % PERIOD]]
            yield np.full(len(place), ids[lo + t]), place, rolling.spans(place + at[t], place + at[t] + rank)


def suffix_keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    ids, found = batch.column("doc_id").to_numpy(), batch.column("found")
    for lo, _, data, at in text_chunks(batch):
        rolling = Rolling(data)
        for t in range(len(at) - 1):
            place = np.flatnonzero(starts_near(byte_and_word(found[lo + t].as_py())[0], PERIOD - 1, int(at[t + 1] - at[t])))
            if len(place):
                yield np.full(len(place), ids[lo + t]), place, rolling.spans(place + at[t], place + at[t] + LENGTH)


def narrowed(texts: DataFrame, found: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The texts with a found place, with all their places, and the folder they are written to."""
    places = found.select(F.col("doc_id").alias("_id"), "found")
    joined = texts.join(places.hint("merge"), texts["doc_id"] == places["_id"])
    kept = joined.select("doc_id", "text", places["found"])
    path = fresh_path(texts.sparkSession, label)
    kept.write.parquet(path)
    return texts.sparkSession.read.schema(kept.schema).parquet(path), path


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words lie in runs of RUN words that were found elsewhere."""
    for batch in batches:
        found, counts = batch.column("found"), np.zeros(batch.num_rows, np.int64)
        for lo, _, data, at in text_chunks(batch):
            starts, ends, first = words(data, at)
            hashes = Rolling(data).spans(starts, ends)
            for t in range(len(at) - 1):
                place = byte_and_word(found[lo + t].as_py())[1]
                if len(place):
                    runs = combine(hashes[first[t] : first[t + 1]], RUN)
                    at_run = np.flatnonzero(np.isin(runs, runs[place]))
                    counts[lo + t] = RUN + np.minimum(np.diff(at_run), RUN).sum()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts)], ["_run", "shared"])


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed bytes, maximal runs of them as (start, end), and the SHA-256 of what is left."""
    for batch in batches:
        n_removed, spans, digest = [], [], []
        for found, text in zip(batch.column("found"), batch.column("text"), strict=True):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            change = np.zeros(len(data) + 1, np.int32)
            place = unpack(found.as_py(), np.uint32)[0].astype(np.int64)
            np.add.at(change, place, 1)
            np.add.at(change, place + LENGTH, -1)
            covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
            edge = np.flatnonzero(covered[1:] != covered[:-1])
            n_removed.append(int(covered.sum()))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            digest.append(hashlib.sha256(data[~covered[1:-1]].tobytes()).hexdigest())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(digest, pa.string())], ["doc_id", "n_removed", "spans", "kept_sha256"])


REMOVED = "doc_id long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per input row: `doc_id`, `n_bytes`, `n_removed`, `spans` (removed runs of bytes), `kept_sha256`, `n_repeated_words`.

    Null texts read as empty; texts under 400 bytes lose nothing.  Equal texts of 400 bytes and more, also
    repeated rows, lose everything.  A row without doc_id is not compared: it loses nothing, and nothing
    is lost for its sake.  A doc_id should have one text.  An empty table gives no rows.

    `n_repeated_words` counts the words (white space between them, case kept) in runs of over 50 that occur in
    another row, too, also where they have under 400 bytes: all words of equal texts of over 50 words.
    """
    whole = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    raw = F.col("text").cast("binary")
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words")
    keyed = materialise(whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_words, F.unhex(F.sha2(raw, 256)).alias("digest")), "keyed")
    long = keyed.filter((F.col("n_bytes") >= LEAST) & F.col("doc_id").isNotNull())
    groups = materialise(long.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")), "groups")
    able = whole.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LEAST))
    seen = repeated_keys(able, anchor_keys).join(groups.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id")
    spark = docs.sparkSession
    texts, anchored = narrowed(able.groupBy("doc_id").agg(F.max_by("text", F.octet_length("text")).alias("text")) if _ids_repeat(long) else able, seen, "anchored")
    # Each step's texts go as soon as the next step's are written.
    texts, ranked = narrowed(texts.drop("found"), repeated_keys(texts, cover_keys), "ranked")
    drop_path(spark, anchored)
    alike = materialise(texts.mapInArrow(shared, "_run long, shared long").filter("shared > 0"), "alike")
    texts, cut = narrowed(texts.drop("found"), repeated_keys(texts, suffix_keys), "cut")
    drop_path(spark, ranked)
    lost = materialise(texts.mapInArrow(removed, REMOVED).withColumnRenamed("doc_id", "_cut"), "lost")
    drop_path(spark, cut)
    copies = groups.filter("size > 1").select("digest", F.lit(True).alias("_copy"))
    marked = keyed.join(copies.hint("merge"), "digest", "left").join(lost.hint("merge"), F.col("doc_id") == F.col("_cut"), "left").join(alike.hint("merge"), F.col("doc_id") == F.col("_run"), "left")
    equal = F.col("_copy").isNotNull() & F.col("doc_id").isNotNull()
    copy = equal & (F.col("n_bytes") >= LENGTH)
    run = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return marked.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, run).otherwise(F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>"))).alias("spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(equal & (F.col("n_words") >= RUN), F.col("n_words")).otherwise(F.coalesce("shared", F.lit(0).cast("long"))).alias("n_repeated_words"),
    )


def _ids_repeat(rows: DataFrame) -> bool:
    """Whether a doc_id occurs twice; then the texts are reduced to one row for each."""
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return bool(counts.limit(1).count())
