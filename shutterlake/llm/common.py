"""Helpers shared by the corpus operators: Arrow texts as byte arrays, rolling hashes, repeated keys.

Texts are handled as UTF-8 bytes.  White space and ASCII letters never occur inside a
multi-byte character, so word borders and lower-casing of A-Z are exact on bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.session import materialise, tune

__all__ = ["materialise", "tune", "documents", "table", "crc_bucket", "free_name", "text_chunks", "repeated_keys"]

CHUNK_BYTES = 1 << 21
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Letters and digits of ASCII, and all bytes of other characters.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.default_rng(20240105).integers(1, 2**64, 256, dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """`doc_id` as long, `text`, and further named columns; everything else is left out.

    Operators read their columns by name here, so extra columns never clash with their own.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def free_name(df: DataFrame, base: str) -> str:
    """`base`, or `base` with a number behind it where `df` has a column of that name (in any case)."""
    taken, name, n = {c.lower() for c in df.columns}, base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo `n`; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each starts (one more for the end); null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_chunks(batch: pa.RecordBatch, name: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts) for runs of rows of about `most` bytes; a longer text is a run of its own."""
    data, at = utf8(batch.column(name))
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any spans of a byte array, from one pass over it."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _TABLE):
        power, self.inverse = _power_tables(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * power[: len(data)], out=self.prefix[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])


def words(data: np.ndarray, at: np.ndarray, inside: np.ndarray = ~WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words (runs of `inside` bytes; none crosses texts), and the first word of each text."""
    mask = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = mask[:-1]
    starts = np.flatnonzero(mask & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = mask[1:]
    ends = np.flatnonzero(mask & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each `k` neighbouring values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * _BASE + h[i : i + n]
    return mix(out)


def shingles(word_hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `k`-word shingles of texts, in order, and where each text's start.

    A text with fewer words has one: its whole sequence.
    """
    counts = np.diff(first)
    grams = combine(word_hashes, k)
    short = np.flatnonzero((counts > 0) & (counts < k))
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(at[-1], np.uint64)
    long = np.flatnonzero(counts >= k)
    if len(long):
        source = np.repeat(first[long] - at[long], n[long])
        target = np.repeat(at[long], n[long]) + (np.arange(n[long].sum()) - np.repeat(np.cumsum(n[long]) - n[long], n[long]))
        out[target] = grams[target + source]
    for t in short:
        c = int(counts[t])
        out[at[t]] = combine(word_hashes[first[t] : first[t] + c], c)[0]
    return out, at


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    """Arrays of one length each, as packed."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, start = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, start))
        start += n * np.dtype(k).itemsize
    return out


Emit = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]
_FLUSH = 1 << 21


def repeated_keys(rows: DataFrame, emit: Emit, counts: bool = False) -> DataFrame:
    """Which of the keys that `emit` finds in each batch occur more than once over all rows.

    `emit(batch)` yields (doc_id int64, position uint32, key uint64) arrays.  Result: `doc_id` and `found`
    (packed uint32 positions whose key occurs again anywhere, another row or the same), one row for a
    document that has such; with `counts`, `n` instead: how many there are.

    Keys are dealt by value to as many buckets as `spark.sql.shuffle.partitions`, in packed blocks.  A
    key that occurs again within a run of rows is known to repeat at once: one of its places goes to the
    bucket for the others' sake, so a hot key sends one place per run and not one per row.  What is found
    goes back in blocks dealt by doc_id.
    """
    buckets = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sent(parts: list) -> Iterator[pa.RecordBatch]:
        ids, places, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
        size = np.diff(np.concatenate([start, [len(keys)]]))
        again = np.zeros(len(keys), bool)
        again[order] = np.repeat(size > 1, size)
        lead = np.zeros(len(keys), bool)
        lead[order[start]] = True
        bucket = (keys % np.uint64(buckets)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        by = by[lead[by]]
        border = np.searchsorted(bucket[by], np.arange(buckets + 1))
        out_bucket, out_kind, blobs = [], [], []
        for b in np.flatnonzero(np.diff(border)):
            i = by[border[b] : border[b + 1]]
            out_bucket.append(int(b))
            out_kind.append(0)
            blobs.append(pack(keys[i], ids[i], places[i], again[i].astype(np.uint8)))
        known = np.flatnonzero(again & ~lead)
        if len(known):  # spread over the buckets only to be passed on
            target = (mix(ids[known].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(target, kind="stable")
            known, target = known[order], target[order]
            edge = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1], [True]]))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                out_bucket.append(int(target[lo]))
                out_kind.append(1)
                blobs.append(pack(ids[known[lo:hi]], places[known[lo:hi]]))
        yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_kind, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for batch in batches:
            for ids, places, keys in emit(batch):
                parts.append((ids.astype(np.int64), places.astype(np.uint32), keys))
                if sum(len(p[2]) for p in parts) >= _FLUSH:
                    yield from sent(parts)
                    parts = []
        if parts:
            yield from sent(parts)

    def settle(group: pa.Table) -> pa.Table:
        open_blobs, ids, places = [], [], []
        for kind, blob in zip(group["kind"].to_pylist(), group["blob"], strict=True):
            if kind:
                i, p = unpack(blob.as_py(), np.int64, np.uint32)
                ids.append(i)
                places.append(p)
            else:
                open_blobs.append(unpack(blob.as_py(), np.uint64, np.int64, np.uint32, np.uint8))
        if open_blobs:
            keys, i, p, again = (np.concatenate(x) for x in zip(*open_blobs, strict=True))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            same = np.concatenate([[False], keys[1:] == keys[:-1]])
            repeated = same | np.concatenate([same[1:], [False]]) | again[order].astype(bool)
            chosen = order[repeated]
            ids.append(i[chosen])
            places.append(p[chosen])
        i = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        p = np.concatenate(places) if places else np.zeros(0, np.uint32)
        target = (mix(i.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(target, kind="stable")
        i, p, target = i[order], p[order], target[order]
        edge = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1], [True]])) if len(i) else np.zeros(1, int)
        blobs = [pack(i[a:b], p[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table([pa.array(target[edge[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def gather(group: pa.Table) -> pa.Table:
        i, p = (np.concatenate(x) for x in zip(*(unpack(b.as_py(), np.int64, np.uint32) for b in group["blob"]), strict=True))
        order = np.lexsort((p, i))
        i, p = i[order], p[order]
        edge = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1], [True]]))
        names = pa.array(i[edge[:-1]], pa.int64())
        if counts:
            return pa.table([names, pa.array(np.diff(edge), pa.int64())], ["doc_id", "n"])
        return pa.table([names, pa.array([pack(p[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["doc_id", "found"])

    blocks = rows.mapInArrow(deal, "bucket int, kind int, blob binary")
    settled = blocks.groupBy("bucket").applyInArrow(settle, "bucket int, blob binary")
    return settled.groupBy("bucket").applyInArrow(gather, "doc_id long, n long" if counts else "doc_id long, found binary")
