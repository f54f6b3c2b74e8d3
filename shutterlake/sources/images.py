"""Perceptual hashes from pixels [S5, X2].

Decoding is done by Spark's image source.  The only Python code of the package runs
here: grey 32x32 pixels to 64 cosine coefficients, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from shutterlake.sources.listing import list_files

SIDE, LOW = 32, 8
LISTING_TASKS = 32


def _basis() -> np.ndarray:
    """First 8 rows of the 32-point DCT-II, scaled so that B P B' has factor 1/4."""
    u, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    rows = np.cos((2 * x + 1) * u * np.pi / (2 * SIDE))
    rows[0] /= np.sqrt(2.0)
    return rows / 2.0


def _coefficients(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    basis = _basis()
    for batch in batches:
        good = [p is not None and len(p) == SIDE * SIDE for p in batch["pixels"]]
        out: list[np.ndarray | None] = [None] * len(batch)
        chosen = [np.asarray(p, dtype=np.float64) for p, ok in zip(batch["pixels"], good) if ok]
        if chosen:
            low = basis @ np.stack(chosen).reshape(-1, SIDE, SIDE) @ basis.T
            for i, row in zip(np.flatnonzero(good), low.reshape(-1, LOW * LOW)):
                out[i] = row
        yield batch.drop(columns="pixels").assign(coefficients=out)


def dct_coefficients(images: DataFrame) -> DataFrame:
    """[X2] Replace `pixels` (1,024 grey values, row by row) by `coefficients`: the 8x8
    lowest ones, row by row.  Other shapes give NULL; all other columns stay.
    """
    kept = [f for f in images.schema.fields if f.name != "pixels"]
    schema = StructType([*kept, StructField("coefficients", ArrayType(DoubleType()))])
    return images.select(*[f.name for f in kept], "pixels").mapInPandas(_coefficients, schema)


def _grey_square(height: int, width: int, channels: int, data: bytes) -> list[int] | None:
    """Decoded BGR(A) bytes to 32x32 grey: white background, area average."""
    pixels = np.frombuffer(data, dtype=np.uint8)
    if height <= 0 or width <= 0 or pixels.size != height * width * channels or channels not in (1, 3, 4):
        return None
    image = pixels.reshape(height, width, channels).astype(np.float64)
    if channels == 4:
        alpha = image[:, :, 3:] / 255.0
        image = image[:, :, :3] * alpha + 255.0 * (1.0 - alpha)
    if channels == 1:
        grey = image[:, :, 0]
    else:
        grey = image[:, :, :3] @ np.array([0.0722, 0.7152, 0.2126])
    grey = _area_weights(height) @ grey @ _area_weights(width).T
    return np.clip(np.floor(grey + 0.5), 0, 255).astype(int).ravel().tolist()


def _area_weights(length: int) -> np.ndarray:
    """Share of each source pixel in each of 32 equal stretches of the axis."""
    edges = np.arange(SIDE + 1) * (length / SIDE)
    low, high = edges[:-1, None], edges[1:, None]
    start = np.arange(length)[None, :]
    overlap = np.clip(np.minimum(high, start + 1) - np.maximum(low, start), 0, None)
    return overlap / (length / SIDE)


def _squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        grey = [
            _grey_square(h, w, c, d)
            for h, w, c, d in zip(batch["height"], batch["width"], batch["nChannels"], batch["data"])
        ]
        yield pd.DataFrame({"key": batch["key"], "pixels": grey})


def read_pixels(spark: SparkSession, path: str | list[str], drop_invalid: bool = True) -> DataFrame:
    """[S5] (key, pixels) of the images below a path; what cannot be decoded is left out, or has NULL pixels."""
    images = spark.read.format("image").option("dropInvalid", drop_invalid).load(path).select("image.*")
    # The source gives paths encoded like URLs.
    origin = F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))
    flat = images.select(F.regexp_extract(origin, r"([^/]+)\z", 1).alias("key"), "height", "width", "nChannels", "data")
    return flat.mapInPandas(_squares, "key string, pixels array<int>")


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """[S5, S2] (key, path) of all files below a folder; no file is opened."""
    return list_files(spark, folder).select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("key"), "path")


def read_listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """[S5] (key, pixels) of just these files, with NULL pixels for what cannot be decoded."""
    if not paths:
        return spark.createDataFrame([], "key string, pixels array<int>")
    # The source takes patterns; here every character stands for itself.  Some tasks ask for the files' sizes, not one for each file.
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), LISTING_TASKS))
    try:
        return read_pixels(spark, [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths], drop_invalid=False)
    finally:
        spark.conf.set(name, before)
