"""URL filter: a curated rule list, and association rules mined from it for the URLs that it leaves open.

A rule names a host and a path; it fits the host and its subdomains where the URL's path starts with the
rule's, and the longest fitting rule decides.  The URLs that the list decides carry its verdict as their label;
those that it leaves open have the label `Mining.unlisted`, or none and are not learned from (the query's way, for
else the rules learn the default back).  Spark's FP-growth mines token combinations of the labelled URLs together with their labels; rules "tokens -> label" of enough support and confidence, of which none
with fewer tokens is as sure, judge the open URLs.  So an open URL gets the verdict of the labelled URLs with its tokens.
Rules are matched by an inverted index: each is filed under its rarest token, and looked up by the tokens of a URL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import materialise

# The curated list, (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    """Least share of the labelled URLs, and of those with a rule's tokens, that a rule needs.

    All tokens of a URL are mined.  FP-growth drops those below the least support first; what is left of
    a URL are its common tokens, and the number of rules grows with how many of these come together.
    """

    support: float = 0.002
    confidence: float = 0.9
    # Label of the URLs that the list leaves open; None: nothing is learned from them.
    unlisted: str | None = DEFAULT


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def curated(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of rules of one length the longer host's."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host_ == rule_host) | F.endswith(host_, F.lit("." + rule_host))) & F.startswith(path_, F.lit(rule_path))
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host_: Column, path_: Column) -> Column:
    """Distinct tokens of a URL: host labels (the last one marked as such), path parts with digits as '#', the first marked as such."""
    labels = F.filter(F.split(host_, r"\."), lambda x: x != "")
    last = F.transform(F.slice(F.reverse(labels), 1, 1), lambda x: F.concat(F.lit("top:"), x))
    names = F.transform(F.slice(F.reverse(labels), 2, 1_000_000), lambda x: F.concat(F.lit("host:"), x))
    parts = F.transform(F.filter(F.split(path_, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    first = F.transform(F.slice(parts, 1, 1), lambda x: F.concat(F.lit("first:"), x))
    rest = F.transform(F.slice(parts, 2, 1_000_000), lambda x: F.concat(F.lit("path:"), x))
    return F.array_distinct(F.concat(last, first, names, rest))


def mine(labelled: DataFrame, p: Mining = Mining()) -> DataFrame:
    """Rules (`tokens`, `verdict`, `confidence`, `support`, `anchor`) from rows of `tokens` and `verdict`."""
    item = F.concat(F.lit("="), F.col("verdict"))
    baskets = labelled.filter(F.size("tokens") > 0).select(F.concat("tokens", F.array(item)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=p.support, minConfidence=p.confidence).fit(baskets)
    count = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("_token"), "freq")
    found = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit("=")) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("="))))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 1000).alias("verdict"), F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"))
    found = materialise(found, "rules")
    # A rule goes if a rule without one of its tokens says the same as surely.
    shorter = found.filter(F.size("tokens") > 1).select(
        "tokens", "verdict", "confidence", F.explode("tokens").alias("_out")
    ).withColumn("_less", F.filter("tokens", lambda t: t != F.col("_out")))
    simple = found.select(F.col("tokens").alias("_less"), "verdict", F.col("confidence").alias("_sure"))
    spare = shorter.join(simple, ["_less", "verdict"]).filter("_sure >= confidence").select("tokens", "verdict").distinct()
    kept = found.join(spare, ["tokens", "verdict"], "left_anti")
    counted = kept.select("*", F.explode("tokens").alias("_token")).join(count, "_token")
    rarest = counted.groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "_token"))["_token"].alias("anchor"))
    return materialise(rarest, "rules")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """For each row of `tokens` the surest rule whose tokens it has: `tokens`, `mined`, `confidence`; others are left out."""
    filed = rules.select(F.col("tokens").alias("_needs"), F.col("verdict").alias("mined"), "confidence", "support", "anchor")
    tried = sets.select("tokens", F.explode("tokens").alias("anchor")).join(filed, "anchor")
    fits = tried.filter(F.size(F.array_except("_needs", "tokens")) == 0)
    order = F.struct("confidence", "support", F.size("_needs").alias("n"), "mined", "_needs")
    return fits.groupBy("tokens").agg(F.max(order).alias("_best")).select("tokens", F.col("_best.mined").alias("mined"), F.col("_best.confidence").alias("confidence"), F.col("_best._needs").alias("needs"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, p: Mining = Mining()) -> DataFrame:
    """One row per input row: `page_id`, `host`, `path`, `rule`, `verdict`, `by` (the mined rule's tokens), `confidence`.

    A null url, and one without "://", has an empty host and path, no tokens, and the default verdict, allow;
    so have URLs that no rule fits, all open ones where the list decides nothing.  Rows without page_id and repeated rows are judged like others.
    URLs of equal tokens are judged once.  An empty table gives no rows.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("_by_list", curated(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    rows = materialise(rows, "urls")
    label = F.coalesce("_by_list.verdict", F.lit(p.unlisted).cast("string"))
    labelled = rows.filter("size(tokens) > 0").select("tokens", label.alias("verdict")).filter("verdict is not null")
    open_sets = rows.filter("_by_list is null and size(tokens) > 0").select("tokens").distinct()
    found = materialise(match(open_sets, mine(labelled, p)), "matched") if labelled.limit(1).count() else None
    listed = rows.filter("_by_list is not null or size(tokens) = 0").withColumns({"mined": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "needs": F.lit(None).cast("array<string>")})
    if found is None:
        others = rows.filter("_by_list is null and size(tokens) > 0").withColumns({"mined": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "needs": F.lit(None).cast("array<string>")})
    else:
        others = rows.filter("_by_list is null and size(tokens) > 0").join(found.hint("merge"), "tokens", "left")
    return listed.unionByName(others).select(
        "page_id",
        "host",
        "path",
        F.col("_by_list.rule").alias("rule"),
        F.coalesce("_by_list.verdict", "mined", F.lit(DEFAULT)).alias("verdict"),
        F.array_join("needs", " ").alias("by"),
        "confidence",
    )
