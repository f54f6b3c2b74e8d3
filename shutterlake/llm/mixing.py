"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic), each with its tokens.  Raking scales the
cells' weights to the target shares of sources, then of languages, then of topics, again and again, until all
three fit.  The ratio of a cell's weight to its tokens is the rate of its documents; divided by the largest
rate, it is the probability with which each of them is sampled, so no document is taken twice.

That scale is the SQL's, and a single small cell may set it.  With `keep`, a share of the tokens, the scale comes from
that budget instead: weights are raked under the bound that no cell gives more than its tokens, and cells above
the scale are taken whole, so the sample has the budget's tokens however small a cell is.

Only DataFrame functions are used.  There are at most as many cells as the product of the target tables'
sizes (plus one row each for unlisted values), which is checked; so sums over cells are windows in one small task, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shutterlake.llm.common import free_name, materialise

DIMENSIONS = ("source", "lang", "topic")
# Stands for values without a target of their own; its target is the entry under this name, else 0.
OTHER = "(other)"
MOST_CELLS = 1_000_000
SWEEPS = 12
# Fixed value: the share of tokens that the pipeline keeps.  `src0` has 4.8% of the sample corpus's tokens and is to have
# 20%, so without taking documents twice its targets can be met up to a share of 24%.
KEEP = 0.2

# The topics of the sample corpus, by what a text contains; the first that fits counts.
TOPICS = [("legal", "License"), ("tabular", " | "), ("noisy", "%%%"), ("contact", "@")]
REST = "prose"

# Target shares for the sample corpus.
TARGETS: dict[str, dict[str, float]] = {
    "source": {"src0": 0.20, **{f"src{i}": 0.04 for i in range(1, 20)}, OTHER: 0.04},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.13, OTHER: 0.02},
    "topic": {"prose": 0.80, "legal": 0.05, "tabular": 0.05, "noisy": 0.05, "contact": 0.05},
}


def topic(text: Column) -> Column:
    out = F.lit(REST)
    for name, mark in reversed(TOPICS):
        out = F.when(F.contains(text, F.lit(mark)), name).otherwise(out)
    return out


def token_count(text: Column) -> Column:
    """Tokens by the usual estimate of four bytes each, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of every row; null values of a dimension are unlisted ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic(text).alias("topic"), token_count(text).alias("tokens"))


def listed(rows: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """Values without a target are renamed to OTHER."""
    for d in DIMENSIONS:
        rows = rows.withColumn(d, F.when(F.col(d).isin(list(targets[d])), F.col(d)).otherwise(OTHER))
    return rows


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]], sweeps: int = SWEEPS, keep: float | None = None) -> DataFrame:
    """Cells (the dimensions, `tokens`) with `weight`: shares of the whole that fit the target shares.

    Cells of a value whose target is 0 or missing are left out.  Targets of a dimension need not add up to 1:
    shares of values without cells are spread over the others in proportion.  A sweep scales each dimension
    once; targets that contradict each other are met as nearly as the last sweep gets.  With `keep`, weights
    are shares of the cells' tokens that add up to `keep` or less, and no weight is more than the cell's own share.
    """
    if keep is not None and not 0 < keep <= 1:
        raise ValueError(f"keep is a share of the tokens, not {keep}")
    bound = 1
    for d in DIMENSIONS:
        bound *= len(targets[d]) + 1
    if bound > MOST_CELLS:
        raise ValueError(f"target tables allow {bound} cells; at most {MOST_CELLS} are raked")
    spark = cells.sparkSession
    now = cells.filter("tokens > 0")
    for d in DIMENSIONS:
        shares = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items() if v > 0], f"{d} string, _share_{d} double")
        now = now.join(F.broadcast(shares), d)
    now = now.withColumn("weight", F.col("tokens").cast("double")).coalesce(1)
    everything = W.partitionBy(F.lit(0))
    for d in DIMENSIONS:
        rows_of_value = F.count(F.lit(1)).over(W.partitionBy(d))
        now = now.withColumn("_part", F.col(f"_share_{d}") / rows_of_value)
        now = now.withColumn(f"_share_{d}", F.col(f"_share_{d}") / F.sum("_part").over(everything)).drop("_part")
    if keep is not None:
        now = now.withColumn("_most", F.col("tokens") / F.sum("tokens").over(everything))
    for sweep in range(sweeps):
        for d in DIMENSIONS:
            now = now.withColumn("weight", F.col("weight") * F.col(f"_share_{d}") / F.sum("weight").over(W.partitionBy(d)))
            if keep is not None:
                now = now.withColumn("weight", F.least(F.col("weight") * keep, "_most"))
        if sweep % 4 == 3:
            now = materialise(now, "raked").coalesce(1)
    return now.select(*DIMENSIONS, "tokens", "weight")


def budgeted(raked: DataFrame, keep: float) -> DataFrame:
    """Raked cells with `_p`, min(1, c * rate), where c is such that `keep` of all their tokens are expected.

    Cells in falling order of rate are taken whole as long as the scale that the rest would need asks for it.
    """
    everything = W.partitionBy(F.lit(0))
    above = everything.orderBy(F.desc("_rate"), *DIMENSIONS).rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("tokens").over(everything)
    now = raked.coalesce(1).withColumn("_budget", total * keep).withColumn("_w", F.col("weight") * total)
    now = now.withColumn("_rate", F.col("_w") / F.col("tokens"))
    left = F.col("_budget") - F.coalesce(F.sum("tokens").over(above), F.lit(0))
    rest = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(above), F.lit(0.0))
    now = now.withColumn("_whole", left * F.col("_rate") >= rest)
    whole = F.coalesce(F.sum(F.when(F.col("_whole"), F.col("tokens"))).over(everything), F.lit(0))
    scale = (F.col("_budget") - whole) / F.sum(F.when(~F.col("_whole"), F.col("_w"))).over(everything)
    now = now.withColumn("_scale", scale)
    return now.withColumn("_p", F.when(F.col("_whole"), 1.0).otherwise(F.least(F.lit(1.0), F.col("_scale") * F.col("_rate"))))


def draw(doc_id: Column) -> Column:
    """A number from 0 up to 1 from the md5 of doc_id; null for null."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 2**32


def mixture(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, sweeps: int = SWEEPS, keep: float | None = None) -> DataFrame:
    """One row per input row: `doc_id`, `source`, `lang`, `topic`, `tokens`, `probability`, `sampled`.

    A row is sampled if a number drawn from its doc_id is below its probability, so repeated rows share
    their fate.  Values without a target, and nulls, count as the value "(other)".  Documents without
    tokens (null and empty texts) and rows without doc_id have probability 0.  An empty table gives no rows.
    With `keep`, that share is expected of the tokens that can be sampled: those of rows with doc_id in cells with targets.
    """
    rows = materialise(measured(docs), "measured")
    counted = rows if keep is None else rows.filter("doc_id is not null")
    cells = listed(counted, targets).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    raked = materialise(rake(cells, targets, sweeps, keep), "weights")
    if keep is None:
        rates = raked.withColumn("_rate", F.col("weight") / F.col("tokens"))
        top = rates.agg(F.max("_rate").alias("_top"))
        rates = rates.crossJoin(F.broadcast(top)).withColumn("_p", F.col("_rate") / F.col("_top"))
    else:
        rates = budgeted(raked, keep)
    rates = rates.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "_p")
    keyed = listed(rows.select("*", *[F.col(d).alias(f"_in_{d}") for d in DIMENSIONS]), targets)
    joined = keyed.join(F.broadcast(rates), [F.col(d) == F.col(f"_{d}") for d in DIMENSIONS], "left")
    p = F.when((F.col("tokens") > 0) & F.col("doc_id").isNotNull(), F.coalesce("_p", F.lit(0.0))).otherwise(0.0)
    return joined.select(
        "doc_id",
        *[F.col(f"_in_{d}").alias(d) for d in DIMENSIONS],
        "tokens",
        F.round(p, 6).alias("probability"),
        F.coalesce(draw(F.col("doc_id")) < p, F.lit(False)).alias("sampled"),
    )


def _sql() -> str:
    """The same in DuckDB's SQL: one chain of common table expressions, a dimension of a sweep each."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN contains(t, {quote(m)}) THEN {quote(n)}" for n, m in TOPICS)
    out = [
        f"rows0 AS (SELECT doc_id, source, lang, CASE {cases} ELSE {quote(REST)} END AS topic, CAST(ceil(strlen(t) / 4) AS BIGINT) AS tokens"
        " FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents))"
    ]
    for d in DIMENSIONS:
        values = ", ".join(f"({quote(k)}, CAST({v!r} AS DOUBLE))" for k, v in TARGETS[d].items())
        out.append(f"target_{d}(v, share) AS (VALUES {values})")
    names = ", ".join(f"CASE WHEN {d} IN (SELECT v FROM target_{d}) THEN {d} ELSE {quote(OTHER)} END AS in_{d}" for d in DIMENSIONS)
    out.append(f"keyed AS (SELECT *, {names} FROM rows0)")
    dims = ", ".join(f"in_{d}" for d in DIMENSIONS)
    joins = " ".join(f"JOIN target_{d} t_{d} ON t_{d}.v = in_{d} AND t_{d}.share > 0" for d in DIMENSIONS)
    shares = ", ".join(f"max(t_{d}.share) AS share_{d}" for d in DIMENSIONS)
    out.append(f"base AS (SELECT {dims}, CAST(sum(tokens) AS DOUBLE) AS tokens, {shares} FROM keyed {joins} GROUP BY {dims} HAVING sum(tokens) > 0)")
    whole = ", ".join(f"share_{d} / (SELECT sum(share) FROM target_{d} WHERE v IN (SELECT in_{d} FROM base)) AS share_{d}" for d in DIMENSIONS)
    out.append(f"w0 AS MATERIALIZED (SELECT {dims}, tokens, tokens AS weight, {whole} FROM base)")
    k = 0
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            out.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (weight * share_{d} / sum(weight) OVER (PARTITION BY in_{d}) AS weight) FROM w{k})")
            k += 1
    out.append(f"rates AS (SELECT {dims}, weight / tokens / (SELECT max(weight / tokens) FROM w{k}) AS p FROM w{k})")
    return (
        "WITH " + ",\n".join(out) + "\nSELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, u < p AS sampled FROM (\n"
        "  SELECT k.*, CASE WHEN k.tokens > 0 THEN coalesce(r.p, 0) ELSE 0 END AS p,\n"
        "    CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u\n"
        f"  FROM keyed k LEFT JOIN rates r USING ({dims}))"
    )


OP5_SQL = _sql()


def drop_unsampled(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, keep: float | None = None) -> DataFrame:
    """The sampled rows with all their columns, and `probability`, under which the sample is unbiased.

    Where the documents have a column of that name it stays, and ours has a number behind its name.
    """
    mine, name = free_name(docs, "_chosen"), free_name(docs, "probability")
    chosen = mixture(docs, targets, keep=keep).filter("sampled").groupBy(F.col("doc_id").alias(mine)).agg(F.max("probability").alias(name))
    out = docs.join(chosen.hint("merge"), docs["doc_id"].cast("long") == chosen[mine])
    return out.select(*[docs[c] for c in docs.columns], chosen[name])
