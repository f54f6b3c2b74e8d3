"""Benchmark decontamination: passages of benchmark items in documents, also with edits.

Items and documents are word sequences (runs of letters and digits, A-Z lower-cased).  A window of a
document as long as an item matches it within `max_edit` times the item's words of word edit distance.

* An item that may have e edits is cut into e + 1 pieces of equal length.  An edit touches one piece at most, so
  every passage within e edits of the item holds one of its pieces unchanged.
* CGK embedding (Chakraborty, Goldenberg, Koucky, 2016): a random walk reads a sequence, at each step
  copying the word under its pointer and moving on by a random bit that depends on the step and the word.
* Bit-sampling LSH: a few steps of the walk, drawn at random, are a key.  Windows as long as a piece are walked
  from every word of every document; a window whose key is one of the pieces' keys makes a candidate.  Equal words
  give equal walks, so the unchanged piece is found whatever steps are drawn: recall is 1 for items of every
  length.  More steps only make fewer candidates that fail.
* A candidate is verified by its exact edit distance to the item, over all spans around the window.

Windows with a word that no item has are not walked: they equal no piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import LOWER, WORDLIKE, Rolling, documents, mix, text_chunks, words


@dataclass(frozen=True)
class Lsh:
    """`bits`: steps of a walk that make a key; `block`: items broadcast at a time (a text each); `min_words`: shorter items are no evidence of a leak."""

    max_edit: float = 0.15
    bits: int = 8
    min_words: int = 8
    block: int = 20_000


class Items:
    """The keys of a block of items' pieces, by length of piece; bitmaps of them are made where they are used."""

    marks: list | None = None

    def bitmaps(self) -> list[tuple[np.uint64, np.ndarray]]:
        if self.marks is None:
            self.marks = [bits_of(keys) for *_, keys, _, _ in self.bands]
        return self.marks

    def __init__(self, ids: list, hashes: list[np.ndarray], p: Lsh):
        self.p, self.ids, self.hashes = p, ids, hashes
        self.shift, self.vocabulary = bits_of(np.unique(np.concatenate(hashes)))
        rng = np.random.default_rng(11)
        length = np.array([len(h) for h in hashes])
        pieces = np.array([budget(n, p) + 1 for n in length.tolist()])
        sizes = np.maximum(length // pieces, 1)
        before = np.cumsum(length) - length
        flat = np.concatenate(hashes)
        self.bands = []
        for size in np.unique(sizes).tolist():
            group = np.flatnonzero(sizes == size)
            n = np.minimum(pieces[group], length[group])
            owner = np.repeat(group, n)
            offset = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * size
            steps = 2 * size
            plan = (int(rng.integers(1, 2**63)), [np.sort(rng.choice(steps, min(p.bits, steps), replace=False))])
            start = before[owner] + offset
            keys = walk(flat, start, start + size, plan)[0]
            order = np.argsort(keys, kind="stable")
            self.bands.append((size, plan, keys[order], owner[order], offset[order]))


def bits_of(keys: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """A bitmap of the keys' first bits, 64 for each key: other keys are mostly told by it at once."""
    bits = max(12, int(64 * len(keys)).bit_length())
    shift = np.uint64(64 - bits)
    mark = np.zeros(1 << bits, bool)
    mark[keys >> shift] = True
    return shift, mark


def budget(n_words: int, p: Lsh) -> int:
    return math.floor(p.max_edit * n_words + 1e-9)


def walk(h: np.ndarray, start: np.ndarray, stop: np.ndarray, plan: tuple[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Keys of one walk over the sequences h[start:stop], one array for each draw; past its end a sequence reads zeros."""
    seed, draws = plan
    at, coin = start.copy(), np.uint64(seed | 1)
    keys = [np.full(len(start), np.uint64(7 + d), np.uint64) for d in range(len(draws))]
    wanted: dict[int, list[int]] = {}
    for d, steps in enumerate(draws):
        for s in steps:
            wanted.setdefault(int(s), []).append(d)
    for step in range(max(wanted) + 1):
        over = at >= stop
        word = h[np.minimum(at, len(h) - 1)]
        word[over] = 0
        for d in wanted.get(step, ()):
            keys[d] = keys[d] * np.uint64(0x9E3779B97F4A7C15) + word
        turn = np.uint64((seed * (2 * step + 1) + 0x632BE59BD9B4E019 * step) & (2**64 - 1))
        at = at + ((((word ^ turn) * coin) >> np.uint64(63)) == 1)
    return [mix(k) for k in keys]


def edit_spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each region doc[lo:hi] the least edit distance of the item to a span of it, and that span.

    One dynamic programme for all regions at once; a column is a place in the region, where a span may
    begin and end freely.
    """
    width = int((hi - lo).max())
    place = lo[:, None] + np.arange(width)
    text = np.where(place < hi[:, None], doc[np.minimum(place, len(doc) - 1)], np.uint64(0))
    cost = np.zeros((len(lo), width + 1), np.int64)
    begin = np.broadcast_to(np.arange(width + 1), cost.shape).copy()
    shift = np.arange(width + 1)
    for word in item:
        take = cost[:, :-1] + (text != word)
        skip = cost[:, 1:] + 1
        step = np.empty_like(cost)
        first = np.empty_like(begin)
        step[:, 0], first[:, 0] = cost[:, 0] + 1, begin[:, 0]
        step[:, 1:] = np.minimum(take, skip)
        first[:, 1:] = np.where(take <= skip, begin[:, :-1], begin[:, 1:])
        level = step - shift
        best = np.minimum.accumulate(level, axis=1)
        source = np.maximum.accumulate(np.where(level == best, shift, 0), axis=1)
        cost = best + shift
        begin = np.take_along_axis(first, source, axis=1)
    cost[place[:, -1:] * 0 + shift > (hi - lo)[:, None]] = np.iinfo(np.int64).max
    end = cost.argmin(axis=1)
    rows = np.arange(len(lo))
    return cost[rows, end], lo + begin[rows, end], lo + end


def shared_words(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
    """For each region doc[lo:hi], at most how many of its words the item has; an edit distance leaves all but as many."""
    mark = np.zeros(1 << 16, bool)
    mark[item >> np.uint64(48)] = True
    place = lo[:, None] + np.arange(int((hi - lo).max()))
    inside = mark[doc[np.minimum(place, len(doc) - 1)] >> np.uint64(48)] & (place < hi[:, None])
    return inside.sum(axis=1)


def find(data: np.ndarray, at: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, edits, first byte, end byte) for each text and item that match: the nearest, then first span."""
    data = LOWER[data]
    starts, ends, first = words(data, at, WORDLIKE)
    if not len(starts):
        return
    h = Rolling(data).spans(starts, ends)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    last = first[doc + 1]
    known = np.concatenate([np.zeros(1, np.int64), np.cumsum(items.vocabulary[h >> items.shift])])
    found = []
    for (size, plan, table, owner, offset), (shift, mark) in zip(items.bands, items.bitmaps(), strict=True):
        begin = np.arange(len(h))
        end = np.minimum(begin + size, last)
        begin = begin[(known[end] - known[begin] == size)]
        if not len(begin):
            continue
        keys = walk(h, begin, begin + size, plan)[0]
        hit = np.flatnonzero(mark[keys >> shift])
        lo, hi = np.searchsorted(table, keys[hit], "left"), np.searchsorted(table, keys[hit], "right")
        n = hi - lo
        piece = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at_word = np.repeat(begin[hit], n)
        # Where the item would begin, which may be before the document does.
        found.append(np.stack([owner[piece], at_word - offset[piece], doc[at_word]], axis=1))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    for group in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(rows) else []:
        item = int(group[0, 0])
        sequence = items.hashes[item]
        most = budget(len(sequence), items.p)
        for part in np.array_split(group, len(group) * len(sequence) // 200_000 + 1):
            place, text = part[:, 1], part[:, 2]
            lo = np.maximum(place - most, first[text])
            hi = np.minimum(place + len(sequence) + most, first[text + 1])
            lo, hi, part = (x[shared_words(h, lo, hi, sequence) >= len(sequence) - most] for x in (lo, hi, text))
            if not len(part):
                continue
            edits, a, b = edit_spans(h, lo, hi, sequence)
            for q in np.flatnonzero(edits <= most):
                key, value = (int(part[q]), item), (int(edits[q]), int(a[q]), int(b[q]))
                best[key] = min(best.get(key, value), value)
    for (text, item), (edits, a, b) in sorted(best.items()):
        yield text, item, edits, int(starts[a]) - int(at[text]), int(ends[b - 1]) - int(at[text])


def blocks(benchmark: DataFrame, p: Lsh) -> Iterator[Items]:
    """The items in blocks of about `block`, dealt by hash; equal word sequences of a block are walked once each."""
    rows = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = math.ceil(rows.count() / p.block)
    for b in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect()
        ids, hashes = [], []
        for r in sorted(part, key=lambda r: (r["item_id"], r["text"])):
            data = LOWER[np.frombuffer(r["text"].encode(), np.uint8)]
            starts, ends, _ = words(data, np.array([0, len(data)]), WORDLIKE)
            if len(starts) >= p.min_words:
                ids.append(r["item_id"])
                hashes.append(Rolling(data).spans(starts, ends))
        if ids:
            yield Items(ids, hashes, p)


def contamination(docs: DataFrame, benchmark: DataFrame, p: Lsh = Lsh()) -> DataFrame:
    """Matches: `doc_id`, `item_id`, `n_edits`, `start`, `end` (code points of the nearest span, then the first).

    One row for a document and item.  Null, empty and very short texts match nothing; so do items under
    `min_words` words and without item_id.  A row without doc_id is searched too, and reported with a null
    doc_id; repeated rows are reported each.  Without items or documents there are no rows.
    """
    schema = "doc_id long, item_id long, n_edits int, start long, end long"
    whole, result = documents(docs), None
    for items in blocks(benchmark, p):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, out = batch.column("doc_id").to_pylist(), []
                for lo, _, data, at in text_chunks(batch):
                    for text, item, edits, a, b in find(data, at, sent.value):
                        raw = data[at[text] : at[text + 1]].tobytes()
                        start = len(raw[:a].decode())
                        out.append((ids[lo + text], sent.value.ids[item], edits, start, start + len(raw[a:b].decode())))
                columns = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_edits", "start", "end"])

        part = whole.mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: Lsh = Lsh()) -> DataFrame:
    """The documents without those that hold a passage of an item; each row is judged by its own text."""
    schema = docs.schema
    for items in blocks(benchmark, p):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, data, at in text_chunks(batch):
                    for text, *_ in find(data, at, sent.value):
                        clean[lo + text] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
