import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shutterlake.llm.mixing import DIMENSIONS, KEEP, OTHER, drop_unsampled, mixture, rake
from shutterlake.llm.token_counts import VOCABULARY, at_limits, encoding, length_report, quantiles, token_counts

from .helpers import by_id, docs, prose

TARGETS = {"source": {"s1": 0.5, "s2": 0.3, OTHER: 0.2}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 0.9, "contact": 0.1}}


def test_raking_meets_all_targets(spark):
    cells = [(s, g, t, n) for k, (s, g, t, n) in enumerate((s, g, t, 10 + 7 * i * j + k) for i, s in enumerate(TARGETS["source"]) for j, g in enumerate(TARGETS["lang"]) for k, t in enumerate(TARGETS["topic"]))]
    raked = rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), TARGETS, 20)
    for d in DIMENSIONS:
        for row in raked.groupBy(d).agg(F.sum("weight").alias("w")).collect():
            assert row["w"] == pytest.approx(TARGETS[d][row[d]], abs=1e-6)


def test_mixture(spark):
    rows = [(i, prose(i, 40) + (" me@home" if i % 3 == 0 else ""), "en" if i % 8 < 4 else "de", f"s{1 + i % 4}") for i in range(3000)]
    rows += [(9001, None, "en", "s1"), (9002, "", "en", "s1"), (9003, "text", None, None), (9004, "text", "fr", "s1"), (None, prose(1, 40), "en", "s2"), (1, prose(1, 40), "en", "s2")]
    table = docs(spark, rows)
    got = mixture(table, TARGETS)
    assert got.count() == len(rows)
    out = by_id(got)
    assert [out[i].probability for i in (9001, 9002, 9004, None)] == [0.0] * 4
    assert max(r.probability for r in out.values()) == 1.0
    chosen = [r for r in got.collect() if r.sampled]
    total = sum(r.tokens for r in chosen)
    for d in DIMENSIONS:
        for value, share in TARGETS[d].items():
            names = {"s3", "s4"} if value == OTHER else {value}
            assert sum(r.tokens for r in chosen if r[d] in names) / total == pytest.approx(share, abs=0.06)
    kept = drop_unsampled(table, TARGETS)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in chosen)
    assert kept.columns == [*table.columns, "probability"]
    assert mixture(docs(spark, []), TARGETS).count() == 0


def test_a_tiny_cell_does_not_thin_the_corpus(spark):
    rows = [(i, prose(i, 40), ("en", "de", "fr", "es")[i % 4], f"src{i % 20}") for i in range(4000)]
    rows += [(9001, "me@home", "es", "src0"), (9002, "one | two", "fr", "src3")]
    table = docs(spark, rows)
    kept = {r.doc_id: r for r in corpus_pipeline.source_mixing(spark, table, "").collect()}
    tokens = {i: -(-len(t.encode()) // 4) for i, t, *_ in rows}
    assert sum(tokens[i] for i in kept) == pytest.approx(KEEP * sum(tokens.values()), rel=0.1)
    assert kept[9001].probability == kept[9002].probability == 1.0
    out = by_id(mixture(table, keep=KEEP))
    assert sum(r.tokens * r.probability for r in out.values()) == pytest.approx(KEEP * sum(tokens.values()), rel=1e-3)
    assert {round(r.probability, 3) for r in mixture(table, keep=1.0).collect()} == {1.0}
    assert mixture(docs(spark, []), keep=KEEP).count() == 0


def test_token_counts(spark):
    texts = [None, "", "a", "Hello world", "  \n\n x", "é漢字 😀", prose(1, 500), "naïve's " * 3000, "<|endoftext|>", "a"]
    encoder = encoding(VOCABULARY)
    want = [len(encoder.encode_ordinary(t or "")) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a")]
    out = token_counts(docs(spark, rows))
    assert {r.doc_id: r.n_tokens for r in out.filter("doc_id is not null").collect()} == dict(enumerate(want))
    for t in texts[1:]:
        assert encoder.decode(encoder.encode_ordinary(t)) == t
    want.append(1)
    report = length_report(docs(spark, rows))
    lines = {r.n_tokens: r for r in report.collect()}
    assert set(lines) == set(want)
    for limit, r in lines.items():
        assert (r.n_docs, r.docs_at_least, r.docs_at_most) == (want.count(limit), sum(n >= limit for n in want), sum(n <= limit for n in want))
        assert (r.tokens_at_least, r.total_tokens, r.truncated_tokens) == (sum(n for n in want if n >= limit), sum(want), sum(min(n, limit) for n in want))
    for r in at_limits(report, [0, 2, 700, 10**6]).collect():
        assert (r.docs_over, r.tokens_cut, r.truncated_tokens) == (sum(n > r.limit for n in want), sum(max(n - r.limit, 0) for n in want), sum(min(n, r.limit) for n in want))
    q = quantiles(report, [0.5, 0.9, 1.0]).first()
    ordered = sorted(want)
    assert (q["q0.5"], q["q0.9"], q["q1"]) == (ordered[5], ordered[9], ordered[10])
    assert length_report(docs(spark, [])).count() == 0
