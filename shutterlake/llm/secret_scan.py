"""Secret scan: known patterns, and strings that a primed compressor finds new.

Known patterns are matched as they are: assignments to words such as password, access keys, long hexadecimal
runs.  Beyond them, a string of 16 and more token characters near a sensitive word, before or behind it, is a
candidate.  It is reported if zstandard, primed with the identifiers of all such neighbourhoods and with the text around
the candidate, still needs nearly all the bytes that a random string over the candidate's alphabet takes:
marginal bytes = compressed(context + candidate) - compressed(context).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import documents, materialise

# Patterns of known kinds, in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
# A text without any of these in lower case has no assignment; the test is a plain search.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# A maximal run of 24 hexadecimal digits; shorter runs fail, so searching for long ones gives the same spans.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
# Words that make a neighbourhood sensitive.
SENSITIVE = re.compile(r"(?i:pass(word|wd|phrase)?|secret|token|key|auth|credential|bearer|private|signature|cookie|session)", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
IDENTIFIER = re.compile(r"[A-Za-z_]{4,}")


@dataclass(frozen=True)
class Novelty:
    """`before`, `around`: characters on either side searched for a sensitive word, and taken as context.

    `identifiers` bounds the dictionary, and so what is broadcast; `ratio`: least marginal bytes for each byte of a
    string over 64 characters; over fewer characters, in proportion to the bits that each of them has.
    """

    before: int = 48
    around: int = 96
    identifiers: int = 4_000
    ratio: float = 0.7
    level: int = 3


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the known patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    out = []
    folded = text.lower()
    if any(w in folded for w in ASSIGN_WORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(*m.span(), 2) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str, known: list[tuple[int, int, int]], p: Novelty) -> Iterator[tuple[int, int, str]]:
    """(start, end, context) of strings with letters near a sensitive word, clear of known spans; digits alone are a number."""
    covered, at = sorted((a, b) for a, b, _ in known), 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        # Spans of several kinds may overlap, so one that ends later can stand behind the pointer's.
        if any(x < b and y > a for x, y in covered[max(at - 2, 0) : at + 3]):
            continue
        if any(c.isalpha() for c in m[0]) and (SENSITIVE.search(text, max(0, a - p.before), a) or SENSITIVE.search(text, b, b + p.before)):
            yield a, b, text[max(0, a - p.around) : a] + text[b : b + p.around]


SCANNED = "doc_id long, known array<struct<start: int, end: int, kind: int>>, candidates array<struct<start: int, end: int, value: string, context: string>>"
FOUND = "doc_id long, found array<struct<kind: string, start: int, end: int, novelty: double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
_CANDIDATE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("context", pa.string())]))
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))


def scan(docs: DataFrame, p: Novelty = Novelty()) -> DataFrame:
    """Known spans and candidates of every row; null texts read as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, more = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                known = known_spans(text)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in known])
                more.append([{"start": a, "end": b, "value": text[a:b], "context": c} for a, b, c in candidates(text, known, p)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPAN), pa.array(more, _CANDIDATE)], ["doc_id", "known", "candidates"])

    return documents(docs).mapInArrow(run, SCANNED)


def identifiers(scanned: DataFrame, p: Novelty = Novelty()) -> list[str]:
    """The identifiers that occur most in the contexts of all candidates; `identifiers` of them at most."""
    context = scanned.select(F.explode("candidates.context").alias("context"))
    word = context.select(F.explode(F.regexp_extract_all("context", F.lit(f"({IDENTIFIER.pattern})"), 1)).alias("word")).filter(F.length("word") <= 64)
    top = word.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(p.identifiers)
    return [r["word"] for r in top.collect()]


def compressor(words: list[str], level: int) -> zstandard.ZstdCompressor:
    """Primed with the words, the most frequent nearest to the data."""
    raw = " ".join(reversed(words)).encode()
    if len(raw) < 8:
        return zstandard.ZstdCompressor(level=level)
    primed = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=primed)


def novelty(zstd: zstandard.ZstdCompressor, value: str, context: str) -> float:
    """Marginal compressed bytes of the value after its context, for each of its bytes."""
    before, own = context.encode(), value.encode()
    return (len(zstd.compress(before + own)) - len(zstd.compress(before))) / len(own)


def bits(value: str) -> float:
    """Bits of a character of a random string over the kinds of characters in the value, 6 at most."""
    letters = sum(6 if max(own) in "abcdefABCDEF" else 26 for own in ({c for c in value if c.islower()}, {c for c in value if c.isupper()}) if own)
    digits = 10 if any(c.isdigit() for c in value) else 0
    return min(math.log2(max(letters + digits + len(set(value) & set("+/_=-")), 2)), 6)


def is_novel(value: str, share: float, p: Novelty) -> bool:
    return share >= p.ratio * bits(value) / 6


def secrets(docs: DataFrame, p: Novelty = Novelty()) -> DataFrame:
    """One row per input row: `doc_id`, `found` (kind, start, end in code points, novelty) by start, then kind.

    Novelty is null for known kinds.  Null and empty texts have no spans; rows without doc_id and repeated
    rows are scanned like others.  An empty table gives no rows.
    """
    scanned = materialise(scan(docs, p), "scanned")
    sent = docs.sparkSession.sparkContext.broadcast(identifiers(scanned, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = compressor(sent.value, p.level)
        for batch in batches:
            out = []
            for known, more in zip(batch.column("known").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                spans = [(s["start"], s["kind"], s["end"], None) for s in known]
                for c in more:
                    share = novelty(zstd, c["value"], c["context"])
                    if is_novel(c["value"], share, p):
                        spans.append((c["start"], 3, c["end"], share))
                out.append([{"kind": KINDS[k], "start": a, "end": b, "novelty": share} for a, k, b, share in sorted(spans, key=lambda s: s[:2])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, _FOUND)], ["doc_id", "found"])

    return scanned.mapInArrow(run, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the known kinds, the SHA-256 of their spans, and all spans as text."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    of = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    base = F.filter("found", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
