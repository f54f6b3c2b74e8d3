"""Token counts: the exact histogram of encoded lengths, and what follows from it.

Every whole text is encoded once, with a public byte-level BPE vocabulary.  Documents are counted by length;
sums over the lengths from one on up (suffix sums) then give the documents and tokens of any context limit, so totals,
quantiles and truncated totals need no second pass over the texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.llm.common import documents, materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's encoder cuts a text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Lengths are summed in blocks of so many, then over blocks.
BLOCK = 1024


def encoding(vocabulary: str) -> tiktoken.Encoding:
    """The encoder of a vocabulary file of lines "base64 rank"; without special tokens."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc_id`, `n_tokens` of every row; null and empty texts have none.

    `vocabulary` is a path that every executor can open (installed with the encoder's package).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(vocabulary)
        for batch in batches:
            n = [len(encoder.encode_ordinary(t.as_py() or "")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(n, np.int64))], ["doc_id", "n_tokens"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    """`n_tokens`, `n_docs`: documents by length, combined before the shuffle."""
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(lengths: DataFrame) -> DataFrame:
    """For every length that occurs, what holds if it is the context limit.

    `docs_at_least`, `tokens_at_least`: documents of that length and more, and their tokens; `docs_at_most`;
    `total_tokens` if nothing is cut; `truncated_tokens` if every document is cut to the limit.  Blocks
    of 1,024 lengths are summed each in its task; only one row for each block meets in one task.
    """
    block = F.floor(F.col("n_tokens") / BLOCK)
    rows = materialise(lengths.withColumn("_block", block).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")
    after = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_docs_after"), F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_tokens_after"))
    totals = rows.agg(F.sum("n_docs").alias("_docs"), F.sum("_tokens").alias("total_tokens"))
    inside = W.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.withColumn("_in_d", F.sum("n_docs").over(inside)).withColumn("_in_t", F.sum("_tokens").over(inside))
    out = out.join(blocks.hint("merge"), "_block").crossJoin(F.broadcast(totals))
    docs_from = F.col("_in_d") + F.col("_docs_after")
    tokens_from = F.col("_in_t") + F.col("_tokens_after")
    return out.select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_at_least"),
        tokens_from.alias("tokens_at_least"),
        (F.col("_docs") - docs_from + F.col("n_docs")).alias("docs_at_most"),
        "total_tokens",
        (F.col("total_tokens") - tokens_from + docs_from * F.col("n_tokens")).alias("truncated_tokens"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: `docs_over`, `tokens_cut`, `truncated_tokens`; limits that no document has as its length included."""
    out = []
    for limit in limits:
        longer = F.col("n_tokens") > limit
        out.append(
            sums.agg(
                F.lit(limit).cast("long").alias("limit"),
                F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
                F.coalesce(F.sum(F.when(longer, F.col("n_docs") * (F.col("n_tokens") - limit))), F.lit(0)).alias("tokens_cut"),
                F.coalesce(F.sum(F.col("n_docs") * F.least(F.col("n_tokens"), F.lit(limit))), F.lit(0)).alias("truncated_tokens"),
            )
        )
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """For each share, the least length that at least this share of the documents does not exceed."""
    docs = F.col("docs_at_most") + F.col("docs_at_least") - F.col("n_docs")
    return sums.agg(*[F.min(F.when(F.col("docs_at_most") >= F.ceil(F.lit(q) * docs), F.col("n_tokens"))).alias(f"q{q:g}") for q in shares])


def length_report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """`suffix_sums` of the documents' lengths: a row for every length that occurs.

    Null and empty texts count as documents of length 0; rows without doc_id and repeated rows count as
    rows.  An empty table gives no rows.
    """
    return suffix_sums(histogram(token_counts(docs, vocabulary)))
