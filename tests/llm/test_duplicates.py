import hashlib

import numpy as np
import pytest

from shutterlake.llm import jaccard_join
from shutterlake.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, new_index, digests
from shutterlake.llm.jaccard_join import SET, Join, bundle_links, drop_near_duplicates, near_duplicates
from shutterlake.llm.suffix_dedup import COVER, PERIOD, repeated_spans

from .helpers import by_id, components, docs, prose, repeated_words, repeats, word_set

EDGES = [(1, None), (2, ""), (3, "  \n\t"), (None, "lost row here now"), (4, "One TWO three"), (5, "one two three"), (6, "É one")]


def test_exact_edge_cases(spark):
    rows = [*EDGES, (9, "one two THREE"), (10, "same id twice"), (10, "same id twice"), (11, "é one")]
    got = exact_duplicates(docs(spark, rows))
    assert got.count() == len(rows)
    out = by_id(got)
    assert (out[1].keep_id, out[2].keep_id, out[2].kept, out[1].group_size) == (2, 2, True, 2)
    assert [out[i].keep_id for i in (4, 5, 9)] == [9, 9, 9] and out[4].group_size == 3
    assert out[6].keep_id == 6 and out[11].keep_id == 11  # only A-Z are folded
    assert out[10].group_size == 2 and out[10].kept
    assert out[None].keep_id is None and not out[None].kept
    assert out[4].text_sha256 == hashlib.sha256(b"one two three").hexdigest()
    kept = drop_exact_duplicates(docs(spark, rows))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect()) == [(False, i) for i in (2, 3, 6, 9, 10, 11)] + [(True, None)]
    assert kept.columns == docs(spark, rows).columns
    assert exact_duplicates(docs(spark, [])).count() == 0


def test_index_admits_only_new_texts(spark):
    index = new_index(spark)
    assert index.admit(digests(docs(spark, [(1, "a"), (2, "A"), (3, "b")])), 0).count() == 2
    assert [r.keep_id for r in index.admit(digests(docs(spark, [(9, "a"), (8, "c")])), 1).collect()] == [8]
    assert sorted(r.keep_id for r in index.rows().collect()) == [2, 3, 8]
    plan = digests(docs(spark, [(1, "a")])).join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the index is read in place
    whole = index.compact(f"{index.name}_c", f"{index.path}_c")
    assert whole.rows().count() == 3


def near_corpus() -> list[tuple]:
    rows = [(100 + i, prose(i, 40 + i)) for i in range(20)]
    for i in range(12):  # one large group of near copies, a chain, and pairs near the threshold
        words = prose(500, 120).split()
        words[3 * i] = f"edit{i}"
        rows.append((200 + i, " ".join(words)))
    for i in range(8):
        words = prose(600, 100).split()
        words[: 2 * i] = [f"chain{j}" for j in range(2 * i)]
        rows.append((300 + i, " ".join(words)))
    for i in range(8):
        words = prose(700 + i, 60).split()
        rows += [(400 + 2 * i, " ".join(words)), (401 + 2 * i, " ".join(words[: 60 - 1 - i]))]
    rows += [(500, "a b c d e f"), (501, "a b c d e f g h i j"), (502, "x y"), (503, "X  y"), (504, prose(500, 120).upper())]
    return rows


@pytest.mark.parametrize("p", [Join(), Join(pivots=8, pivot_items=900, region_weight=3000)])
def test_near_duplicates_equal_brute_force(spark, p):
    rows = near_corpus()
    out = by_id(near_duplicates(docs(spark, rows), p))
    sets = {i: word_set(t) for i, t in rows}
    assert {i: out[i].n_shingles for i in sets} == {i: len(s) for i, s in sets.items()}
    assert {i: out[i].component_id for i in sets} == components(sets)


def test_the_stage_values_equal_brute_force_in_small_regions(spark):
    rows = near_corpus()
    out = by_id(near_duplicates(docs(spark, rows), Join(percent=80, k=5, pivots=8, pivot_items=900, region_weight=3000)))
    assert {i: out[i].component_id for i, _ in rows} == components({i: word_set(t, 5) for i, t in rows}, 80)


def test_small_clusters_need_no_rounds_however_many_they_are(spark, monkeypatch):
    rows = [(10 * c + k, prose(500 + c, 60) + (f" extra{k}" if k else "")) for c in range(60) for k in range(3)]
    p = Join(pivots=4, pivot_items=400, region_weight=3000)
    rounds = []
    monkeypatch.setattr(jaccard_join, "spread_pivots", lambda *a: rounds.append(1))
    out = by_id(near_duplicates(docs(spark, rows), p))
    assert {i: out[i].component_id for i, _ in rows} == components({i: word_set(t) for i, t in rows}, 85)
    assert not rounds


def test_bundles_hold_all_similar_sets_of_any_sizes(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(40):
        base = rng.integers(0, 4000, rng.integers(1, 120)).astype(np.uint64)
        for k in range(4):
            keep = base[rng.random(len(base)) < 0.93]
            more = rng.integers(0, 4000, rng.integers(0, 4)).astype(np.uint64)
            items = np.unique(np.concatenate([keep, more]))
            rows.append((4 * c + k, len(items), bytearray(items.tobytes())))
    rows = [r for r in rows if r[1]]
    sets = {i: set(np.frombuffer(bytes(x), np.uint64).tolist()) for i, _, x in rows}
    edges = bundle_links(spark.createDataFrame(rows, SET), Join()).collect()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        root[find(e.src)] = find(e.dst)
    similar = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(similar) > 20
    assert all(find(i) == find(j) for i, j in similar)


def test_near_duplicates_edge_cases(spark):
    long = prose(1, 3000) + " " + "w" * 50_000
    rows = [*EDGES, (7, long), (8, long + " end"), (10, "twice one two three"), (10, "twice one two three")]
    got = near_duplicates(docs(spark, rows))
    assert got.count() == len(rows)
    out = by_id(got)
    assert [(out[i].n_shingles, out[i].component_id) for i in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert out[None].component_id is None and out[None].n_shingles == 1
    assert out[5].component_id == 4 and out[8].component_id == 7 and out[10].component_id == 10
    kept = drop_near_duplicates(docs(spark, rows))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 10, 10]
    assert near_duplicates(docs(spark, [])).count() == 0


def test_cover_is_a_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_repeated_spans_equal_brute_force(spark):
    shared, other = prose(1, 90), prose(2, 60)
    rows = [(i, prose(100 + i, 80)) for i in range(5)]
    rows += [(10, prose(10, 30) + shared + prose(11, 20)), (11, "é" * 7 + prose(12, 10) + shared), (12, shared[5:420] + "Ω" + prose(13, 5))]
    rows += [(20, "a" * 900), (21, other[:400]), (22, "x" + other[:400] + "y"), (23, other[:399]), (24, prose(14, 70) + other + prose(15, 3) + other)]
    rows += [(30, prose(16, 100)), (31, prose(16, 100)), (32, "same short"), (33, "same short"), (1000, None), (1001, "")]
    out = by_id(repeated_spans(docs(spark, rows)))
    want = repeats(dict(rows))
    for i, expected in want.items():
        r = out[i]
        assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) == expected, i


def test_repeated_spans_edge_cases(spark):
    text = prose(3, 100)
    rows = [(1, text), (1, text), (None, prose(4, 100)), (2, prose(4, 100) + " more")]
    got = repeated_spans(docs(spark, rows)).collect()
    assert len(got) == 4
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id == 1)
    assert all(r.n_removed == 0 for r in got if r.doc_id != 1)
    assert repeated_spans(docs(spark, [])).count() == 0


def test_passages_of_over_fifty_words_are_told_where_they_are_short(spark):
    def brief(seed, n):
        return " ".join(w[:2] + w[-3:] for w in prose(seed, n).split())

    shared, other, inner = brief(200, 51), brief(201, 58), brief(202, 60)
    assert max(len(shared), len(other)) < 400
    rows = [(i, prose(210 + i, 30 + 10 * i)) for i in range(8)]
    rows += [(20 + i, f"{prose(220 + i, 40 + i)} {shared}\n{prose(230 + i, 9 * i)}") for i in range(4)]
    rows += [(30, shared[: shared.rindex(" ")]), (31, shared.replace(" ", "\t  ")), (32, shared.upper())]
    rows += [(40, f"{prose(240, 70)} {other}"), (41, f"{other} {prose(241, 5)} {other}"), (42, f"{inner} {prose(242, 20)} {inner}")]
    rows += [(50, brief(203, 55)), (51, brief(203, 55)), (52, brief(204, 50)), (53, brief(204, 50)), (60, None), (61, "")]
    rows += [(70, prose(205, 130)), (71, f"é {prose(205, 130)} more"), (72, prose(205, 130)[40:900])]
    out = by_id(repeated_spans(docs(spark, rows)))
    want, lost = repeated_words(dict(rows)), repeats(dict(rows))
    assert [want[i] for i in (0, 20, 30, 31, 40, 41, 42, 50, 52, 70)] == [0, 51, 0, 51, 58, 116, 0, 55, 0, 130]
    assert {i: r.n_repeated_words for i, r in out.items()} == want
    assert {i: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for i, r in out.items()} == lost
    assert out[20].n_removed == out[40].n_removed == 0


def test_repeated_words_of_rows_with_one_id_and_without(spark):
    text = prose(206, 60)
    rows = [(1, text), (1, text), (2, prose(207, 60)), (None, prose(207, 60)), (3, prose(208, 52)), (3, prose(209, 90)), (4, prose(209, 90)[:450])]
    got = repeated_spans(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [r.n_repeated_words for r in got if r.doc_id == 1] == [60, 60]
    assert all(r.n_repeated_words == 0 for r in got if r.doc_id in (2, None))
