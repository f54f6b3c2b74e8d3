"""Column functions on literal cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import accounts, capacity, hashing, media, text, times


def one(spark, value, build, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(build(F.col("x"))).first()[0]


def test_media_counts(spark):
    keys = "img1.jpg, img2.png, video1.mp4, video2.MOV, image3.webp"
    df = spark.createDataFrame([(keys,), ("",), (None,), (" , ,",)], "x string").select(media.split_keys("x").alias("k"))
    rows = df.select(media.photo_count("k"), media.video_count("k")).collect()
    assert [tuple(r) for r in rows] == [(3, 2), (0, 0), (0, 0), (0, 0)]


@pytest.mark.parametrize(
    ("key", "kind"),
    [("a.JPG", "image/jpeg"), ("a.mov", "video/quicktime"), ("a.gif", "image/gif"), ("a", "image/jpeg"), ("a.x", "image/jpeg")],
)
def test_content_type(spark, key, kind):
    assert one(spark, key, media.content_type) == kind


@pytest.mark.parametrize(
    ("url", "name", "ext"),
    [
        ("https://h.example/a/AbC?format=png&name=x", "AbC", ".png"),
        ("https://h.example/a/b/clip.final.mp4#t", "clip.final", ".mp4"),
        ("https://h.example/a/b/", "b", ".jpg"),
        ("https://h.example", "", ".jpg"),
        ("no url", "no url", ".jpg"),
        ("https://h.example/.hidden", "", ".jpg"),
    ],
)
def test_media_url(spark, url, name, ext):
    assert one(spark, url, media.media_id) == name
    assert one(spark, url, media.url_extension) == ext


def test_status_id_and_object_key(spark):
    assert one(spark, "https://x.com/a/status/123/photo/4", media.status_id) == "123"
    assert one(spark, "https://x.com/a/status/abc", media.status_id) is None
    assert one(spark, "a b(1)_ü.jpg", lambda c: media.object_key(F.lit("me"), c)) == "me_a_b_1___.jpg"


@pytest.mark.parametrize(
    ("raw", "name"),
    [
        ("  @@SomeHandle1  ", "somehandle1"),
        ("https://x.com/SomeHandle1/status/123", "somehandle1"),
        ("x.com/SomeHandle1", "somehandle1"),
        ("https://x.com/", "https://x.com/"),
        ("　@Name　", "name"),
        ("", ""),
        (None, ""),
    ],
)
def test_account_name(spark, raw, name):
    assert one(spark, raw, accounts.account_name) == name


def test_author_columns(spark):
    assert one(spark, " @@ Ann ", accounts.author_handle) == "Ann"
    assert one(spark, "ann", lambda c: accounts.author_label(F.lit(" Nick "), c)) == "Nick@ann"
    assert one(spark, "ann", lambda c: accounts.author_label(F.lit(""), c)) == "@ann"
    assert one(spark, "", lambda c: accounts.author_label(F.lit("Nick"), c)) == "Nick"
    assert one(spark, "@ANN", lambda c: accounts.author_search_text(F.lit("NiCk"), c)) == "nick ann"


@pytest.mark.parametrize(
    ("value", "needle", "hit"),
    [
        ("Hello World", "LO w", True),
        ("É", "é", False),
        ("100% sure", "0% s", True),
        ("1000 sure", "0% s", True),
        ("a\\b_c", "\\b", True),
        ("a_c", "A_C", True),
        ("abc", "a_c", True),
        ("ac", "a_c", False),
        ("back\\slash%", "\\s%h%", True),
    ],
)
def test_like_any(spark, value, needle, hit):
    assert one(spark, value, lambda c: text.like_any(c, needle)) is hit


@pytest.mark.parametrize(
    ("value", "hit"), [("kisakiちゃん", True), ("kisaki", True), ("xkisaki", False), ("a-kisaki!", True), ("kisaki_1", False)]
)
def test_word_pattern(spark, value, hit):
    assert one(spark, value, lambda c: F.regexp_like(c, F.lit(text.word_pattern("kisaki")))) is hit


def test_times(spark):
    now = datetime(2024, 1, 4)

    def at(value, build):
        return one(spark, value, lambda c: build(c.cast("timestamp")))

    assert at("2024-01-01 00:00:00", lambda c: times.expired(c, now)) is False
    assert at("2023-12-31 23:59:59", lambda c: times.expired(c, now)) is True
    assert at("2024-01-01 00:00:00", lambda c: times.hours_left(c, now)) == 0
    assert at("2024-01-02 00:00:01", lambda c: times.hours_left(c, now)) == 25
    assert at("2024-01-02 00:00:00", lambda c: times.expiry_critical(c, now)) is False
    for raw, shown in (("2024-05-06T07:08:09Z", "2024-05-06 07:08:09"), ("2024-05-06", "2024-05-06 00:00:00"), ("x", "1970-01-01 00:00:00"), (None, "1970-01-01 00:00:00")):
        assert one(spark, raw, lambda c: times.timestamp_text(times.canonical_timestamp(c))) == shown
    assert one(spark, "x", lambda c: times.upload_timestamp(c, now)) is None
    assert one(spark, "", lambda c: times.timestamp_text(times.upload_timestamp(c, now))) == "2024-01-04 00:00:00"


@pytest.mark.parametrize(
    ("size", "shown"), [(0, "0 B"), (999, "999 B"), (1000, "1 KB"), (1500, "1.5 KB"), (1234567, "1.23 MB"), (10**10, "10 GB"), (10**16, "10000 TB")]
)
def test_format_bytes(spark, size, shown):
    assert one(spark, size, capacity.format_bytes, "long") == shown


def test_usage(spark):
    row = spark.createDataFrame([(9_999_500_000,)], "t long").select(*[c.alias(n) for n, c in capacity.usage_columns("t").items()]).first()
    assert (row.remaining_bytes, row.percent) == (500_000, 100.0)
    assert one(spark, 9_400_000_000, lambda c: capacity.over_limit(c, F.lit(100_000_000)), "long") is True
    assert one(spark, 9_400_000_000, lambda c: capacity.over_limit(c, F.lit(99_999_999)), "long") is False


def test_hamming(spark):
    assert one(spark, "0" * 16, lambda c: hashing.hamming_hex(c, F.lit("0" * 15 + "f"))) == 4
    assert one(spark, "F" * 16, lambda c: hashing.hamming_hex(c, F.lit("0" * 16))) == 64
    with pytest.raises(Exception, match="invalid hash"):
        one(spark, "abc", lambda c: hashing.hamming_hex(c, F.lit("0" * 16)))
    assert one(spark, "ffffffffffffffff", hashing.hash_from_hex) == -1
    assert one(spark, -2, hashing.hash_to_hex, "long") == "fffffffffffffffe"
    assert one(spark, 4, hashing.similarity_text, "int") == "93.8%"


def test_phash_bits(spark):
    values = [float((i * 37) % 64) for i in range(64)]
    ordered = sorted(values)
    median = (ordered[31] + ordered[32]) / 2
    want = sum(1 << i for i, v in enumerate(values) if v > median)
    assert one(spark, values, hashing.phash_from_coefficients, "array<double>") == hashing.signed(want)
    assert one(spark, [1.0], hashing.phash_from_coefficients, "array<double>") is None
