"""Centroid clustering, importance resampling and token records against plain re-implementations."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shutterlake.llm import binary_records
from shutterlake.llm.binary_records import MASK, Encoder, checksums, parse, read_records, record_report, write_records
from shutterlake.llm.centroids import Clustering, candidates, cluster, cluster_report, hilbert, nearest
from shutterlake.llm.importance import Resampling, drawn, gains, hashes, resampled
from shutterlake.session import fresh_path

from .helpers import docs, prose

# ---- op11


def plain_clusters(rows, k=8, rounds=10, size=64):
    """The contract with Python's whole numbers."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(q) for _, q in first]

    def assign():
        out = []
        for _, q in good:
            d = [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            mine = [q for (_, q), (b, _) in zip(good, found, strict=True) if b == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = assign()
    total = sum(d for _, d in found)
    return sorted(
        ((i, b, d, sum(e for a, e in found if a == b), total, hashlib.sha256(",".join(map(str, centres[b])).encode()).hexdigest()) for (i, _), (b, d) in zip(good, found, strict=True)),
        key=repr,
    )


def vectors(spark, rows, parts=3):
    filled = [(i, v, 1, "x", 7.0) for i, v in rows]
    return spark.createDataFrame(filled, "vec_id long, embedding array<double>, cluster int, curve string, distance double").repartition(parts)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters_equal_plain_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=64) * 0.1 + 0.5 * (i % 5 == 0)).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.25] * 64) for i in range(600)]  # a hot vector
    rows += [(7, rows[7][1]), (None, [0.1] * 64), (2000, None), (2001, []), (2002, [0.0] * 63), (2003, [None] + [0.0] * 63), (2004, [float("nan")] * 64), (2005, [float("-inf")] * 64)]
    got = cluster_report(vectors(spark, rows))
    have = sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr)
    assert have == plain_clusters(rows)


def test_clusters_of_few_equal_large_and_no_vectors(spark):
    few = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-2.0] * 64)]
    have = sorted((tuple(r[c] for c in COLUMNS) for r in cluster_report(vectors(spark, few)).collect()), key=repr)
    assert have == plain_clusters(few)
    large = [(i, [float((i * 7919 + j * 31) % 100_003)] * 32 + [-5.5] * 32) for j in range(1) for i in range(40)]
    have = sorted((tuple(r[c] for c in COLUMNS) for r in cluster_report(vectors(spark, large)).collect()), key=repr)
    assert have == plain_clusters(large)
    assert cluster_report(vectors(spark, [])).count() == 0
    assert cluster_report(vectors(spark, [(1, None), (2, [1.0])])).count() == 0
    with pytest.raises(Exception, match="beyond 64 bits"):
        cluster_report(vectors(spark, [(1, [1e30] * 64)])).count()


def test_boxes_rule_out_only_what_is_never_nearest():
    rng = np.random.default_rng(2)
    pruned = 0
    for _ in range(300):
        m = (rng.normal(size=(30, 6)) * rng.choice([1, 20, 300]) + rng.normal(size=6) * 200).astype(np.int32)
        centroids = (rng.normal(size=(9, 6)) * 250).astype(np.int64)
        centroids[3] = centroids[2]  # a tie
        able = candidates(m.min(axis=0), m.max(axis=0), centroids)
        best, far = nearest(m, centroids)
        plain = ((m[:, None, :].astype(np.int64) - centroids) ** 2).sum(axis=2)
        assert (plain.argmin(axis=1) == best).all() and (plain.min(axis=1) == far).all()
        assert set(best) <= set(able)
        pruned += len(centroids) - len(able)
    assert pruned > 300


def test_boxes_rule_out_centroids_of_separate_groups(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(8, 64)) * 3
    rows = [(i, (middle[i % 8] + rng.normal(size=64) * 0.01).tolist()) for i in range(8000)]
    found, _ = cluster(vectors(spark, rows), Clustering(rounds=2))
    assert found.agg(F.avg("candidates")).first()[0] < 4


def test_hilbert_neighbours_are_one_step_apart():
    for n, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), axis=-1).reshape(-1, n)
        keys = [k.tobytes() for k in hilbert(cells, bits)]
        assert len(set(keys)) == len(keys)
        walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# ---- op12


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_features(text, n):
    words = plain_words(text)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_resampling(rows, goal, n=1, buckets=10_000, percent=10):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, n))

    s, t = counts([x for _, x in rows]), counts(goal)
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out, able = [], []
    for i, text in rows:
        features = plain_features(text, n)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in (zlib.crc32(f.encode()) % buckets for f in features))
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(plain_words(text)) >= 20:
                able.append((-score, i))
        out.append((i, len(features), weight, score))
    ranks = {}
    for r, key in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        ranks.setdefault((key[1], -key[0]), []).append(r)
    return sorted(((*row, ranks.get((row[0], row[3]), [None]).pop(0) if ranks.get((row[0], row[3])) else None) for row in out), key=repr)


def drawn_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_a_plain_one(spark, n):
    rows = [(i, prose(i, 15 + i % 40) + " naïve ÄÖ 漢字's x\x00y") for i in range(300)]
    rows += [(500, None), (501, ""), (502, "--- ,,"), (503, "Word word WORD"), (504, prose(4, 20_000)), (505, "a" * 100_000), (None, prose(5, 50)), (12, rows[12][1]), (12, rows[12][1])]
    goal = [prose(1, 200), "naïve ÄÖ", None, ""]
    target = spark.createDataFrame([(k, t, 1) for k, t in enumerate(goal)], "item_id long, text string, n_words int")
    got = resampled(docs(spark, rows), target, Resampling(n=n))
    assert drawn_rows(got) == plain_resampling(rows, goal, n)
    kept = drawn(docs(spark, rows), target, Resampling(n=n))
    assert kept.columns == docs(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.filter("rank is not null").collect()}


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampled(docs(spark, []), none).count() == 0
    rows = [(i, prose(i, 30)) for i in range(40)]
    assert drawn_rows(resampled(docs(spark, rows), none)) == plain_resampling(rows, [])
    assert (gains(docs(spark, []), none) == 0).all()


def test_chained_sums_are_those_of_joined_words():
    found, n = hashes("One two-THREE née 4".encode(), 3)
    assert n == 5
    assert found == [zlib.crc32(f.encode()) for f in plain_features("One two-THREE née 4", 3)]
    assert hashes(b"", 3) == ([], 0)
    assert hashes(b"a b", 5) == ([zlib.crc32(b"a"), zlib.crc32(b"b"), zlib.crc32(b"a b")], 2)


# ---- op13


def plain_crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_masked_sums():
    assert plain_crc32c(b"123456789") == 0xE3069283  # the published check value
    rng = np.random.default_rng(0)
    sizes = [1, 2, 3, 4, 5, 7, 8, 33, 1000, 1]
    words = rng.integers(0, 2**32, sum(sizes), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum(sizes)])
    for got, a, b in zip(checksums(words, at), at[:-1], at[1:], strict=True):
        crc = plain_crc32c(words[a:b].tobytes())
        assert int(got) == (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


TEXTS = [None, "", "a", "Hello,  WORLD's\n\n42 tést", "漢字 😀 é ́x", "tab\tand\x0bfeed wide\x1cgap", "<|endoftext|> x<|startoftext|>y", "ΑΣ ΣΑΣ. Σ", "İI ǅ", "a" * 100_000, "word " * 50_000, "   x"]


def plain_records(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, out = 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return out


def record_rows(df):
    return sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in df.collect())


def test_records_round_trip(spark):
    rows = [(-5, "below")] + [(3 * i, t) for i, t in enumerate(TEXTS)] + [(100 + i, prose(i, 1 + i % 90)) for i in range(300)] + [(1 << 62, "last")]
    got = record_report(docs(spark, rows[::-1]))
    assert record_rows(got) == plain_records(rows)
    assert record_report(docs(spark, [])).count() == 0


def test_records_of_repeated_and_missing_ids(spark):
    rows = [(None, "no id"), (None, None), (4, "same"), (4, "same"), (4, "other"), (9, "x")]
    got = record_report(docs(spark, rows)).collect()
    want = plain_records(rows)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((repr(i), n, c) for i, _, n, c in want)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, None, 4, 4, 4, 9]
    assert [r.start for r in by_start] == np.cumsum([0] + [r.n_tokens for r in by_start[:-1]]).tolist()


def test_shuffled_reads_splits_and_damage(spark):
    path = fresh_path(spark, "records-test")
    rows = [(i, prose(i, 60)) for i in range(500)]
    write_records(docs(spark, rows), path)
    plain = {r.doc_id: (r.start, list(r.ids)) for r in read_records(spark, path, split_bytes=4096).collect()}
    one, two = ([r.doc_id for r in read_records(spark, path, shuffle=s, split_bytes=4096).collect()] for s in (1, 2))
    assert sorted(one) == sorted(two) == sorted(plain) == list(range(500))
    assert one != two and one != sorted(one)
    assert {r.doc_id: (r.start, list(r.ids)) for r in read_records(spark, path, shuffle=1).collect()} == plain
    assert read_records(spark, path, split_bytes=4096).rdd.getNumPartitions() > 10
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert plain[7][1] == [*tokenizer.encode(rows[7][1], add_special_tokens=False).ids, 2]
    fs, root = pafs.FileSystem.from_uri(path)
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".rec") and f.size]
    raw = bytearray(fs.open_input_file(names[0]).read())
    assert len(list(parse(bytes(raw), 2))) > 0
    raw[40] ^= 1
    with pytest.raises(ValueError, match="sum"):
        list(parse(bytes(raw), 2))
    with pytest.raises(ValueError, match="cut off"):
        list(parse(bytes(raw[:-4]), 2))
    with fs.open_output_stream(names[0]) as out:
        out.write(bytes(raw))
    with pytest.raises(Exception, match="sum does not fit"):
        read_records(spark, path).count()


def test_words_encode_as_whole_texts():
    encoder, whole = (Encoder(public_tokenizers.path("word_bpe_49k.json"), w) for w in (False, True))
    texts = [t or "" for t in TEXTS]
    for got, want in zip(encoder.batch(texts, 2), whole.batch(texts, 2), strict=True):
        assert (got == want).all()


def test_texts_are_encoded_by_the_writer(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    path = fresh_path(spark, "records-test")
    spark.dataSource.register(binary_records.TokenRecords)
    docs(spark, rows).coalesce(1).write.format("token_records").options(vocabulary=public_tokenizers.path("word_bpe_49k.json"), end=7).mode("append").save(path)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for i, t in rows}
    assert {r.doc_id: list(r.ids) for r in read_records(spark, path).collect()} == want


def test_encoder_forgets_pieces_too(monkeypatch):
    monkeypatch.setattr(binary_records, "REMEMBERED", 100)
    encoder, whole = (Encoder(public_tokenizers.path("word_bpe_49k.json"), w) for w in (False, True))
    for k in range(5):
        texts = [" ".join(f"{a}{b}{c}-{a}é{c}" for b in "abcd" for c in "klmn") + f"\tx{k} <s>" for a in "opqrst"[k : k + 2]]
        for got, want in zip(encoder.batch(texts, 2), whole.batch(texts, 2), strict=True):
            assert (got == want).all()
        assert len(encoder.words) + len(encoder.pieces) <= 100 + 80


# ---- names that stages use inside, and cuts that are gone


def test_stages_keep_columns_of_any_name(spark):
    from shutterlake.llm.exact_dedup import drop_exact_duplicates
    from shutterlake.llm.mixing import drop_unsampled

    names = ["_rows", "_Keep", "_digest", "probability", "_chosen", "_probability"]
    rows = [(i, prose(i % 7, 30), "en", "s1", *[f"{n}{i}" for n in names]) for i in range(10)] + [(None, "alone", "en", "s1", *names)] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    kept = drop_exact_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, [r for r in table.filter("doc_id >= 3").collect()] + [table.filter("doc_id is null").first()]))
    sampled = drop_unsampled(table.filter("doc_id is not null"), {"source": {"s1": 1.0}, "lang": {"en": 1.0}, "topic": {"prose": 1.0}})
    assert sampled.columns == [*table.columns, "probability_1"]
    assert {r.probability for r in sampled.collect()} <= {f"probability{i}" for i in range(10)}


def test_rules_are_mined_from_all_tokens_of_a_url(spark):
    from shutterlake.llm.url_filter import Mining, judge

    def deep(i):  # twelve tokens that no other URL has
        return "/".join(chr(97 + i % 26) * (2 + i // 26) + chr(97 + j) for j in range(12))

    rows = [(i, f"http://x.net/es/{deep(i)}/bad") for i in range(50)] + [(100, "http://z.org/q/bad"), (101, "http://z.org/q/good")]
    out = {r.page_id: r for r in judge(spark.createDataFrame(rows, "page_id long, url string"), p=Mining(support=0.3)).collect()}
    assert (out[100].rule, out[100].verdict, out[100].by) == (None, "block", "path:bad")
    assert (out[101].verdict, out[101].by) == ("allow", None)
