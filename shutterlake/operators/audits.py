"""Audit tables: crawl texts and errors, transcodes, image verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.media import is_video
from shutterlake.functions.text import trim_all

# Limits of the transcode audit, and of a person detection.
MIN_OUTPUT_BYTES = 1024
MAX_DURATION_SECONDS, MAX_DURATION_SHARE = 1.5, 0.05
MAX_SIZE_SHARE = 0.85
PERSON_SCORE = 0.5
MAX_ERROR_LINE = 300


def last_crawl_text(accounts: DataFrame) -> DataFrame:
    """[C16] Readable last crawl per account: date, type, mode and count; empty if never."""
    kind = F.when(F.col("last_crawl_type") == "manual", "manual").otherwise("auto")
    mode = F.when(F.col("last_crawl_mode") == "all", "full history").otherwise("latest")
    count = F.coalesce("last_crawl_count", F.lit(0)).cast("string")
    date = F.date_format("last_crawled_at", "d/M/yyyy")
    text = F.concat(F.lit("on "), date, F.lit(" "), kind, F.lit(" crawl, "), mode, F.lit(" (+"), count, F.lit(")"))
    return accounts.withColumns(
        {
            "last_crawl_text": F.coalesce(text, F.lit("")),
            "last_crawl_error": F.coalesce("last_crawl_error", F.lit("")),
        }
    )


def crawl_error_class(output: Column | str) -> Column:
    """[C17] Kind of an extractor failure; the first that applies.

    Fixed values: the texts and codes are those of the extractor's messages.
    """
    output = F.col(output) if isinstance(output, str) else output
    lowered = F.lower(output)

    def has(text: str, c: Column = lowered) -> Column:
        return F.contains(c, F.lit(text))

    return (
        F.when(has("unable to retrieve tweets from this timeline"), "end_of_timeline")
        .when(has("rate limit") | has("429", output), "rate_limit")
        .when(has("401", output) | has("unauthorized"), "unauthorized")
        .when(has("404", output), "not_found")
        .when(has("protected") | has("403", output), "protected")
        .when(has("cookies needed"), "cookies_needed")
        .otherwise("other")
    )


def crawl_error_line(output: Column | str) -> Column:
    """[C17] First line that names an error, else everything; cut to 300 characters."""
    output = F.col(output) if isinstance(output, str) else output
    named = F.filter(
        F.split(output, "\n"),
        lambda line: F.contains(F.lower(line), F.lit("error:")) | F.contains(F.lower(line), F.lit("exception")),
    )
    first = trim_all(F.try_element_at(named, F.lit(1)))
    line = F.coalesce(F.nullif(first, F.lit("")), trim_all(output))
    return F.when(F.length(line) > MAX_ERROR_LINE, F.concat(F.substring(line, 1, MAX_ERROR_LINE), F.lit("..."))).otherwise(line)


def transcode_audit(originals: DataFrame, outputs: DataFrame) -> DataFrame:
    """[C18] Per video: is the output accepted, why not, and bytes saved.

    Both sides hold `key`, `is_valid`, `duration`, `codec`, `size`.
    """
    new = outputs.select("key", *[F.col(c).alias(f"out_{c}") for c in ("is_valid", "duration", "codec", "size")])
    delta = F.abs(F.col("out_duration") - F.col("duration"))
    allowed = F.greatest(F.lit(MAX_DURATION_SECONDS), F.col("duration") * MAX_DURATION_SHARE)
    reason = (
        F.when(F.col("out_size").isNull(), "no output")
        .when(~F.coalesce("out_is_valid", F.lit(False)), "invalid output")
        .when(F.lower(F.coalesce("out_codec", F.lit(""))) != "h264", "wrong codec")
        .when(F.col("out_size") < MIN_OUTPUT_BYTES, "output too small")
        .when((F.col("duration") > 0) & (delta > allowed), "duration differs")
        .when(F.col("out_size") > F.col("size") * MAX_SIZE_SHARE, "too little saved")
    )
    audited = originals.join(new, "key", "left").withColumn("reason", reason)
    accepted = F.col("reason").isNull()
    return audited.withColumns(
        {
            "accepted": accepted,
            "saved_bytes": F.when(accepted, F.col("size") - F.col("out_size")).otherwise(F.lit(0).cast("long")),
        }
    )


def person_seen(detections: DataFrame) -> DataFrame:
    """[C19] (post_id, key, has_person) from detections (label, score); one scan, combined."""
    person = (F.col("label") == "person") & (F.col("score") >= PERSON_SCORE)
    return detections.groupBy("post_id", "key").agg(F.bool_or(F.coalesce(person, F.lit(False))).alias("has_person"))


def image_passes(has_person: Column | str, answer: Column | str) -> Column:
    """[C19] No person fails, an answer starting with N fails; a missing answer passes."""
    has_person = F.col(has_person) if isinstance(has_person, str) else has_person
    refused = F.startswith(F.upper(trim_all(F.coalesce(answer, F.lit("")))), F.lit("N"))
    return F.coalesce(has_person, F.lit(True)) & ~refused


def post_verdicts(media: DataFrame, verdicts: DataFrame) -> DataFrame:
    """[A21] Publish a post when every image passes; videos are not judged.

    `media` is (post_id, key), `verdicts` (post_id, key, passes).  Reasons list one
    post's own failing images.
    """
    judged = media.join(verdicts, ["post_id", "key"], "left")
    image = ~is_video("key")
    failed = image & ~F.coalesce("passes", F.lit(True))
    reasons = F.array_sort(F.collect_list(F.when(failed, F.concat("key", F.lit(": non-portrait")))))
    return judged.groupBy("post_id").agg(
        (F.count_if(failed) == 0).alias("publish"),
        F.when(F.count_if(image) == 0, F.array(F.lit("video-only post"))).otherwise(reasons).alias("reasons"),
    )
