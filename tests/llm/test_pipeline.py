import re

import pytest

import corpus_pipeline
from shutterlake.llm.common import table
from shutterlake.llm.jaccard_join import Join
from shutterlake.llm.queries import QUERIES

from .helpers import components, docs, prose, word_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents").cache(), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF).cache()
        out.append((name, {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in kept.collect()}, docs.columns, kept.columns))
        docs = kept
    return out


def test_stages_keep_columns_and_rows(stages):
    for name, before, after, columns, now in stages:
        assert after.items() <= before.items() and after, name
        assert now == columns or name == "source_mixing"


def test_toxic_stage_follows_the_scores(spark, stages):
    _, before, after, *_ = stages[0]
    scored = {r.doc_id: r.predicted for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    assert set(before) - set(after) == {i for i, p in scored.items() if p}


def test_duplicate_stages_against_brute_force(stages):
    _, before, after, *_ = stages[1]
    fold = {i: re.sub("[A-Z]", lambda m: m[0].lower(), t) for i, t in before.items()}
    assert set(after) == set({t: i for i, t in sorted(fold.items())}.values())
    _, before, after, *_ = stages[2]
    root = components({i: word_set(t) for i, t in before.items()})
    assert set(after) == {i for i in before if root[i] == i}


def test_near_copies_go_at_five_words_and_four_fifths(spark, stages):
    _, before, after, *_ = stages[2]
    root = components({i: word_set(t, 5) for i, t in before.items()}, 80)
    assert set(after) == {i for i in before if root[i] == i}
    words = prose(800, 95).split()
    rows = [(1, " ".join(words)), (2, " ".join({30: "other", 60: "words"}.get(i, w) for i, w in enumerate(words)))]
    rows += [(10 + i, prose(810 + i, 95)) for i in range(3)]
    rows.append((20, " ".join("other" if i in (20, 40, 60) else w for i, w in enumerate(rows[2][1].split()))))  # 76 of 106 shingles
    assert {r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, docs(spark, rows), SF).collect()} == {1, 10, 11, 12, 20}
    with pytest.raises(ValueError):
        Join(percent=75)


def test_no_passage_is_left(spark, stages):
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    _, before, after, *_ = stages[3]
    assert any(x in t for t in before.values() for x in items)
    assert not any(x in t for t in after.values() for x in items)
    assert {i for i, t in before.items() if any(x in t for x in items)} == set(before) - set(after)


def test_run_gives_the_last_stage(spark, stages):
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(stages[-1][2])
