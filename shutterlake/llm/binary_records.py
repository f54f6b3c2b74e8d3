"""Token ids as length-delimited binary records, with a separate index of offsets.

A shard is two files.  `*.rec` holds one record after another:

    length of the data, 8 bytes | masked CRC-32C of these 8 bytes, 4 | data | masked CRC-32C of the data, 4

and the data are the doc_id (8 bytes), a flag word (1: there is a doc_id), the number of ids, the ids (2 or 4 bytes each, as the
vocabulary needs), and zeros up to a multiple of 4.  All numbers are little-endian.  `*.idx` has 16 bytes for each record: where
it begins in the shard, and how many ids the shard's records before it hold; so any record can be read on its own, in any order.

`manifest.json` is written last, by the driver, from one message per task.  It names the files of the tasks that
were committed, so what a lost or repeated task left behind is never read.  Reading splits shards by
their index, checks every sum, and can shuffle: partitions and the records in each, by a seed.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from shutterlake.llm.common import documents
from shutterlake.session import fresh_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
# Text of so many bytes is encoded and written at a time.
RUN_BYTES = 4 << 20
# A partition reads about so many bytes of records.
SPLIT_BYTES = 32 << 20
# Words and pieces remembered with their ids by a Python worker; all are forgotten when there are more.
REMEMBERED = 300_000
# Fixed values of the framing: the polynomial of CRC-32C (reflected), and the constant of masked sums.
POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8
READ = "doc_id long, start long, n_tokens long, ids array<int>"


def _advance_tables(levels: int) -> list[np.ndarray]:
    """For each level k, 4 tables of 256: what 4 * 2^k zero bytes make of each byte of the register."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    word = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32)[:, None] * 8)
    for _ in range(4):
        word = (word >> 8) ^ one[word & 255]
    out = [word]
    for _ in range(levels - 1):
        out.append(_advance(out[-1], out[-1]))
    return out


def _advance(tables: np.ndarray, register: np.ndarray) -> np.ndarray:
    return tables[0][register & 255] ^ tables[1][(register >> 8) & 255] ^ tables[2][(register >> 16) & 255] ^ tables[3][register >> 24]


ADVANCE = _advance_tables(33)


def checksums(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of messages of whole 4-byte words: message i is words[at[i]:at[i + 1]], one word at least.

    A register is linear in the message.  So neighbours are joined pairwise, all messages at a time: the left one
    is advanced by the length of the right one.  An odd number of parts gets a zero part in front, which changes nothing.
    """
    value = words.copy()
    value[at[:-1]] ^= np.uint32(0xFFFFFFFF)
    count, level = np.diff(at), 0
    while len(count) and count.max() > 1:
        odd = count & 1
        half = (count + odd) >> 1
        start = np.concatenate([[0], np.cumsum(2 * half)])
        padded = np.zeros(start[-1], np.uint32)
        shift = start[:-1] + odd - np.concatenate([[0], np.cumsum(count)[:-1]])
        padded[np.arange(len(value)) + np.repeat(shift, count)] = value
        value = _advance(ADVANCE[level], padded[::2]) ^ padded[1::2]
        count, level = half, level + 1
    crc = ~_advance(ADVANCE[0], value)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frames(doc_ids: np.ndarray, named: np.ndarray, ids: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Records of documents (ids of document i: ids[at[i]:at[i + 1]]) as 4-byte words, and where each begins."""
    n = np.diff(at)
    data = 4 + -(-n * width // 4)
    begin = np.concatenate([[0], np.cumsum(data + 4)])
    out = np.zeros(begin[-1], np.uint32)
    head = begin[:-1]
    size = 4 * data.astype(np.uint64)
    out[head], out[head + 1] = size & np.uint64(0xFFFFFFFF), size >> np.uint64(32)
    key = np.where(named, doc_ids, 0).astype(np.int64).view(np.uint64)
    out[head + 3], out[head + 4] = key & np.uint64(0xFFFFFFFF), key >> np.uint64(32)
    out[head + 5], out[head + 6] = named, n
    cells = out.view("<u2" if width == 2 else "<u4")
    cells[np.arange(len(ids)) + np.repeat((head + 7) * (4 // width) - at[:-1], n)] = ids
    pairs = np.stack([out[head], out[head + 1]], axis=1).ravel()
    out[head + 2] = checksums(pairs, np.arange(len(n) + 1) * 2)
    edge = np.concatenate([[0], np.cumsum(data)])
    out[head + 3 + data] = checksums(out[np.arange(edge[-1]) + np.repeat(head + 3 - edge[:-1], data)], edge)
    return out, begin


def parse(raw: bytes, width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of whole records; a wrong length or sum is an error."""
    words, spans, at = np.frombuffer(raw, "<u4"), [], 0
    while at < len(words):
        if at + 7 > len(words):
            raise ValueError("a record is cut off")
        data = (int(words[at]) | int(words[at + 1]) << 32) // 4
        spans.append((at, data))
        at += data + 4
    if not spans:
        return
    head, data = (np.array(x, np.int64) for x in zip(*spans, strict=True))
    if at != len(words):
        raise ValueError("a record is cut off")
    lengths = checksums(np.stack([words[head], words[head + 1]], axis=1).ravel(), np.arange(len(head) + 1) * 2)
    edge = np.concatenate([[0], np.cumsum(data)])
    sums = checksums(words[np.arange(edge[-1]) + np.repeat(head + 3 - edge[:-1], data)], edge)
    if (lengths != words[head + 2]).any() or (sums != words[head + 3 + data]).any():
        raise ValueError("a record's sum does not fit its data")
    for h, d in spans:
        cells = words[h + 7 : h + 3 + d].view("<u2" if width == 2 else "<u4")
        key = int(np.uint64(words[h + 3]) | np.uint64(words[h + 4]) << np.uint64(32))
        yield (key - (key >> 63 << 64) if words[h + 5] else None), cells[: int(words[h + 6])].astype(np.uint32)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs, or a plain path) that driver and executors share."""
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))
    return fs, inner.rstrip("/")


@dataclass
class Shard(WriterCommitMessage):
    place: int
    name: str
    records: int
    tokens: int
    size: int


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("width", "4"))
        self.vocabulary, self.end, self.whole = options.get("vocabulary"), int(options.get("end", END_ID)), options.get("whole") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        """One shard for a task; places follow the order of partitions.  Texts are encoded here, so their ids take no way through Spark."""
        place = TaskContext.get().partitionId()
        name = f"part-{place:06d}-{uuid.uuid4().hex}"
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        records = tokens = size = 0
        with fs.open_output_stream(f"{root}/{name}.rec") as out, fs.open_output_stream(f"{root}/{name}.idx") as index:
            for keys, ids, at in _given(iterator) if self.vocabulary is None else _encoded(iterator, _encoder(self.vocabulary, self.whole), self.end):
                words, begin = frames(keys.fill_null(0).to_numpy(), np.asarray(keys.is_valid()), ids, at, self.width)
                out.write(words.tobytes())
                index.write(np.stack([size + 4 * begin[:-1], tokens + at[:-1]], axis=1).astype("<i8").tobytes())
                records, tokens, size = records + len(keys), tokens + int(at[-1]), size + 4 * int(begin[-1])
        return Shard(place, name, records, tokens, size)

    def commit(self, messages: list) -> None:
        """The manifest; files of tasks that are not in it are deleted."""
        fs, root = opened(self.path)
        shards = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        rows, before = [], 0
        for s in shards:
            rows.append({"name": s.name, "records": s.records, "tokens": s.tokens, "bytes": s.size, "start": before})
            before += s.tokens
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/manifest.json") as out:
            out.write(json.dumps({"width": self.width, "shards": rows}).encode())
        named = {s.name for s in shards}
        for info in fs.get_file_info(pafs.FileSelector(root)):
            if info.base_name.startswith("part-") and info.base_name.rsplit(".", 1)[0] not in named:
                fs.delete_file(info.path)

    def abort(self, messages: list) -> None:
        fs, root = opened(self.path)
        for s in messages:
            for kind in ("rec", "idx"):
                if s is not None and fs.get_file_info(f"{root}/{s.name}.{kind}").type == pafs.FileType.File:
                    fs.delete_file(f"{root}/{s.name}.{kind}")


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.seed = options["path"], options.get("shuffle")  # names of options arrive in lower case
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of records of about `splitBytes`; with `shuffle` (a seed), in an order of its own."""
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/manifest.json") as f:
            manifest = json.loads(f.read())
        out = []
        for s in manifest["shards"]:
            pieces = max(1, min(-(-s["bytes"] // self.split), s["records"]))
            cuts = [s["records"] * k // pieces for k in range(pieces + 1)]
            out += [InputPartition((s["name"], a, b, s["records"], s["bytes"], s["tokens"], s["start"], manifest["width"])) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        if self.seed is not None:
            out = [out[i] for i in np.random.default_rng(int(self.seed)).permutation(len(out))]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no records at all
            return
        name, first, last, records, size, tokens, start, width = partition.value
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/{name}.idx") as index:
            index.seek(16 * first)
            rows = np.frombuffer(index.read(16 * (min(last + 1, records) - first)), "<i8").reshape(-1, 2)
        if last == records:
            rows = np.concatenate([rows, [[size, tokens]]])
        with fs.open_input_file(f"{root}/{name}.rec") as data:
            if self.seed is None:
                at = 0
                while at < last - first:
                    end = max(at + 1, int(np.searchsorted(rows[:, 0], rows[at, 0] + RUN_BYTES, "right")) - 1)
                    end = min(end, last - first)
                    data.seek(int(rows[at, 0]))
                    yield self.batch(parse(data.read(int(rows[end, 0] - rows[at, 0])), width), start + rows[at:end, 1])
                    at = end
                return
            for i in np.random.default_rng([int(self.seed), first, start]).permutation(last - first):
                data.seek(int(rows[i, 0]))
                yield self.batch(parse(data.read(int(rows[i + 1, 0] - rows[i, 0])), width), start + rows[i : i + 1, 1])

    @staticmethod
    def batch(found: Iterator[tuple[int | None, np.ndarray]], starts: np.ndarray) -> pa.RecordBatch:
        keys, ids = zip(*found, strict=True)
        n = np.array([len(i) for i in ids], np.int64)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(np.concatenate(ids).view(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(n), lists], ["doc_id", "start", "n_tokens", "ids"])


class TokenRecords(DataSource):
    """`spark.read.format("token_records")`, `df.write.format("token_records")`; see the module for the files.

    Options: `path`; writing `width` (2 or 4 bytes an id) and, for texts instead of ids, `vocabulary`, `end` and `whole`; reading `shuffle` (a seed) and `splitBytes`.
    """

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options))


class _Known(dict):
    """Numbers for strings, given when they are first asked for, and the ids of numbered strings in one array."""

    def __init__(self):
        self.new: list[str] = []
        self.pool, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def number(self, words: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def take_new(self) -> list[str]:
        new, self.new = self.new, []
        return new

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        """Ids of the new strings, in order."""
        self.pool, self.size = np.concatenate([self.pool, ids]), np.concatenate([self.size, size])

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _spread(self.pool, self.size, numbers)


def _spread(pool: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of numbered strings one after another, and how many each has; `pool` has the ids of string 0, 1, ... in order."""
    count, first = size[numbers], np.cumsum(size) - size
    stop = np.cumsum(count)
    return pool[np.arange(count.sum()) + np.repeat(first[numbers] - (stop - count), count)], count


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What lies between spaces, tabs and line feeds of all texts, one after another, and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].copy()
    raw[(raw == 9) | (raw == 10)] = 32
    blanked = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(raw))
    lists = pc.split_pattern(blanked, " ")
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of whole texts by a vocabulary of the tokenizers library.

    Its normaliser and its pieces never reach across a space, tab or line feed, so a text's ids are those of
    its words between these, one after another.  The different words of a run are encoded once.  Where the vocabulary says that
    it lower-cases and cuts by `PIECES`, words of printable ASCII are cut here, and their pieces go to the library's
    model; other words are encoded together, `JOINED` of them in one call, and told apart by the places of their ids.  Pieces
    and other words are remembered.  (A vocabulary whose pieces hold white space needs `whole=True`, which encodes every text in one go.)
    """

    JOINED = 256
    # The pattern of the vocabulary's pieces, as its file has it, and what that means for ASCII words joined by spaces.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|\x20")

    def __init__(self, path: str, whole: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        kinds = [n.get("type") for n in (parts["normalizer"] or {}).get("normalizers", [])]
        cut = [(c.get("type"), c.get("pattern", {}).get("Regex")) for c in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.cuts = kinds == ["NFC", "Replace", "Lowercase"] and cut == [("Split", self.PIECES), ("ByteLevel", None)] and parts["post_processor"] is None
        self.added = re.compile("|".join(re.escape(t["content"]) for t in parts["added_tokens"]) or r"(?!)")
        self.forget()

    def forget(self) -> None:
        self.words, self.pieces = _Known(), _Known()
        # The space between joined words is piece 0, without ids.
        self.pieces.number([" "])
        self.pieces.take_new()
        self.pieces.add(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of printable ASCII one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        numbers = self.pieces.number(self.ASCII_PIECES.findall(" ".join(words).lower()))
        tokens = [[t.id for t in self.model.tokenize(p)] for p in self.pieces.take_new()]
        self.pieces.add(np.fromiter(chain.from_iterable(tokens), np.uint32), np.array([len(t) for t in tokens], np.int64))
        ids, count = self.pieces.ids(numbers)
        return ids, np.bincount(np.cumsum(numbers == 0), count, len(words)).astype(np.int64)

    def _other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of any kind one after another, and how many each has."""
        numbers = self.words.number(words)
        new, found = self.words.take_new(), [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        for k in range(0, len(new), self.JOINED):
            group = new[k : k + self.JOINED]
            joined = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in group])
            places = np.array([a for a, _ in joined.offsets], np.int64)
            found.append((np.array(joined.ids, np.uint32), np.diff(np.searchsorted(places, starts))))
        ids, size = zip(*found, strict=True)
        self.words.add(np.concatenate(ids), np.concatenate(size))
        return self.words.ids(numbers)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        cut = np.asarray(pc.and_(pc.string_is_ascii(words), pc.ascii_is_printable(words))) & self.cuts
        ours = _strings(words.filter(cut))
        if self.added.search(" ".join(ours)):
            cut[cut] = [not self.added.search(w) for w in ours]
            ours = _strings(words.filter(cut))
        size = np.zeros(len(words), np.int64)
        cut_ids, size[cut] = self._cut(ours)
        other_ids, size[~cut] = self._other(_strings(words.filter(~cut)))
        ids, of_cut = np.zeros(size.sum(), np.uint32), np.repeat(cut, size)
        ids[of_cut], ids[~of_cut] = cut_ids, other_ids
        return ids, size

    def batch(self, texts: pa.Array | Sequence[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with `end` behind it, and where each text's ids start (one more for the end)."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if self.whole:
            found = [[*e.ids, end] for e in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.cumsum([0] + [len(ids) for ids in found])
        if len(self.words) + len(self.pieces) > REMEMBERED:
            self.forget()
        words, n = _words(texts)
        coded = words.dictionary_encode()
        ids, count = _spread(*self.encode_words(coded.dictionary), coded.indices.to_numpy())
        # The end id follows the last word of each text.
        last = np.concatenate([[0], np.cumsum(count)])[np.cumsum(n)]
        at = last + np.arange(1, len(n) + 1)
        out = np.full(len(ids) + len(n), end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[at - 1] = False
        out[keep] = ids
        return out, np.concatenate([[0], at])


@lru_cache(1)
def _encoder(vocabulary: str, whole: bool) -> Encoder:
    """One for each Python worker, which Spark uses for several tasks."""
    return Encoder(vocabulary, whole)


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder, end: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Ids of (doc_id, text) rows, some rows at a time: doc_ids, ids, and where each row's ids start; null texts as empty ones."""
    for batch in batches:
        texts, row = batch.column("text"), 0
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
        while row < batch.num_rows:
            stop = min(max(row + 1, int(np.searchsorted(size, size[row] + RUN_BYTES, "right")) - 1), batch.num_rows)
            yield batch.column("doc_id").slice(row, stop - row), *encoder.batch(texts.slice(row, stop - row), end)
            row = stop


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The same of (doc_id, ids) rows, whose ids (4 bytes each) are there already."""
    for batch in batches:
        column = batch.column("ids").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        at = (offsets - offsets[0]) // 4
        yield batch.column("doc_id"), np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u4") if at[-1] else np.zeros(0, np.uint32), at


def write_records(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END_ID, whole: bool = False) -> None:
    """All texts as token ids, in ascending order of doc_id (rows without one first), in shards under `path`.

    Rows are dealt by ranges of (doc_id, hash of the text), so a doc_id with very many rows is spread over shards.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    width = 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end + 1) <= 1 << 16 else 4
    spark.dataSource.register(TokenRecords)
    order = ["doc_id", F.xxhash64("text"), F.length("text")]
    rows = documents(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    writer = rows.write.format("token_records").options(width=width, vocabulary=vocabulary, end=end, whole=whole)
    writer.mode("append").save(path)


def read_records(spark: SparkSession, path: str, shuffle: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """`doc_id`, `start`, `n_tokens`, `ids` of all records; `start` counts the ids of all records before."""
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format("token_records").option("splitBytes", split_bytes)
    return (reader if shuffle is None else reader.option("shuffle", shuffle)).load(path)


def crc_of_ids(records: DataFrame) -> DataFrame:
    """`ids_crc32`: crc32 of the ids as 4 bytes each, instead of `ids`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return records.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def record_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write all documents as records and read them back: one row per input row.

    Null and empty texts are a record of the end id alone.  Rows without doc_id come first, with a null doc_id.  Rows
    of one doc_id are in order of a hash of their texts.  Texts of any length are encoded whole, and are one record
    each (of less than 2^31 bytes).  An empty table gives no rows.
    """
    path = fresh_path(docs.sparkSession, "records")
    write_records(docs, path, vocabulary)
    return crc_of_ids(read_records(docs.sparkSession, path))
