"""Centroid clustering over zone maps in Hilbert order.

Vectors become integers once, so that every distance, sum and mean is exact.  They are dealt by the Hilbert curve
through a grid over their mean and spread (Skilling, 2004), so neighbours on the curve are near each
other, and are cut into blocks that carry their least and largest components (a box), their sum and their number.

A round looks at boxes first.  For centroids a and b, |v-b|^2 - |v-a|^2 is linear in v, so its least value over
a box is known from one corner; where it is positive, b is nearest to no vector of the block.  The centroid
nearest to the box's middle is held against all others in that way.  A block with one candidate left gives its stored sum;
in all other blocks the vectors are compared with the candidates, exactly.

Blocks are written once to the shared folder; a round reads them and returns one sum per cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import materialise

# Bits of the Hilbert grid for each component.
GRID_BITS = 4
# Vectors of a block.
BLOCK = 256
# Up to here products of components are whole numbers in double precision, for up to 1,024 components.
SMALL = 1 << 21
# Up to here squared distances fit into 64 bits, for up to 64 components.
LARGE = 1 << 27


@dataclass(frozen=True)
class Clustering:
    """`seed` is hashed with the vector's id; the `k` least hashes are the first centroids."""

    k: int = 8
    rounds: int = 10
    size: int = 64
    scale: int = 1024
    seed: str = "3"


def kept(vectors: DataFrame, p: Clustering, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """`vec_id` and `q` (whole components) of the vectors that have `p.size` components, none null or not finite."""
    whole = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    x = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("_x")).filter(F.size("_x") == p.size)
    rows = rows.filter(F.forall("_x", whole))
    return rows.select("vec_id", F.transform("_x", lambda c: F.floor(F.lit(float(p.scale)) * c)).alias("q"))


def first_centroids(rows: DataFrame, p: Clustering) -> np.ndarray:
    """The vectors of the `k` least hashes of their ids; ties (an id that occurs again) by components.

    A vector without an id has no hash and comes after all others.
    """
    place = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    top = rows.select(place.alias("_place"), "q").orderBy(F.asc_nulls_last("_place"), "q").limit(p.k).collect()
    return np.array([r["q"] for r in top], np.int64).reshape(len(top), p.size)


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def spread(rows: DataFrame, p: Clustering) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each component (they only place the grid)."""
    size = p.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, size))
        for batch in batches:
            m = matrix(batch.column("q"), size).astype(float)
            total += [np.full(size, len(m)), m.sum(axis=0), (m * m).sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), *[pa.array(t) for t in total]], ["i", "n", "s", "ss"])

    sums = rows.select("q").mapInArrow(run, "i long, n double, s double, ss double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean, dev = np.zeros(size), np.ones(size)
    for r in sums.collect():
        n = max(r["n"], 1.0)
        mean[r["i"]] = r["s"] / n
        dev[r["i"]] = np.sqrt(max(r["ss"] / n - (r["s"] / n) ** 2, 0.0)) or 1.0
    return mean, dev


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of grid cells (unsigned, below 2^bits), as rows of bytes in order.

    Skilling's transform, one step for all rows at a time: undo the excess work from the highest bit down,
    then Gray-code; the index is the transposed bits.
    """
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= t
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    planes = (x[None, :, :] >> shifts[:, None, None]) & 1  # bit, component, row
    return np.packbits(planes.reshape(bits * n, -1).T.astype(np.uint8), axis=1)


def blocks(rows: DataFrame, p: Clustering) -> DataFrame:
    """Blocks in Hilbert order: `vec_ids`, `has_id`, `vectors` (packed rows), `lo`, `hi`, `total`, `n`.

    Rows are dealt by (curve, place in the input), so any number of equal vectors is spread over tasks.
    """
    size = p.size
    mean, dev = spread(rows, p)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("q"), size)
            if m.max(initial=0) > LARGE or m.min(initial=0) < -LARGE:
                raise ValueError(f"components beyond {LARGE} after scaling have squared distances beyond 64 bits")
            grid = np.clip(np.floor((m - mean) / dev * (1 << (GRID_BITS - 2)) + (1 << (GRID_BITS - 1))), 0, (1 << GRID_BITS) - 1)
            key = hilbert(grid, GRID_BITS)
            keys = pa.array([k.tobytes() for k in key], pa.binary())
            packed = pa.array([v.tobytes() for v in np.ascontiguousarray(m.astype(np.int32))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), keys, packed, batch.column("_row")], ["vec_id", "curve", "vector", "_row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.int32).reshape(-1, size)
            ids = batch.column("vec_id")
            named = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy()
            out: dict[str, list] = {c: [] for c in BLOCKS}
            for at in range(0, len(m), BLOCK):
                part = m[at : at + BLOCK]
                for c, value in zip(BLOCKS, (ids[at : at + BLOCK], named[at : at + BLOCK], part, part.min(axis=0), part.max(axis=0), part.sum(axis=0, dtype=np.int64)), strict=False):
                    out[c].append(np.ascontiguousarray(value).tobytes())
                out["n"].append(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64() if c == "n" else pa.binary()) for c in BLOCKS], list(BLOCKS))

    keyed = rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(place, "vec_id long, curve binary, vector binary, _row long")
    ordered = keyed.repartitionByRange("curve", "_row").sortWithinPartitions("curve", "_row")
    return materialise(ordered.mapInArrow(cut, ", ".join(f"{c} {kind}" for c, kind in BLOCKS.items())), "zones")


BLOCKS = {"vec_ids": "binary", "has_id": "binary", "vectors": "binary", "lo": "binary", "hi": "binary", "total": "binary", "n": "long"}


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector in the box, ascending.

    For the centroid `a` nearest to the box's middle and another `b`: |v-b|^2 - |v-a|^2 = |b|^2 - |a|^2 - 2 v(b-a) is
    least at the corner that takes `hi` where b > a and `lo` elsewhere.  Only a positive least value rules `b` out,
    so ties stay.  Sums of whole numbers in float64 err by less than the margin asked for.
    """
    c = centroids.astype(float)
    a = int(((c - (lo + hi.astype(float)) / 2) ** 2).sum(axis=1).argmin())
    step = c - c[a]
    corner = np.where(step > 0, hi, lo)
    least = (step * (c + c[a] - 2.0 * corner)).sum(axis=1)
    margin = 1e-9 * (np.abs(step) * (np.abs(c) + np.abs(c[a]) + 2.0 * np.abs(corner))).sum(axis=1)
    keep = least <= margin
    keep[a] = True
    return np.flatnonzero(keep)


def nearest(m: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first of the nearest centroids, and the squared distance, both exact."""
    if len(centroids) > 1 and max(np.abs(m).max(initial=0), np.abs(centroids).max(initial=0)) <= SMALL:
        v, c = m.astype(float), centroids.astype(float)
        d = (c * c).sum(axis=1) - 2.0 * (v @ c.T)  # whole numbers below 2^53
        best = d.argmin(axis=1)
    elif len(centroids) > 1:
        wide = m.astype(np.int64)
        best = np.stack([((wide - c) ** 2).sum(axis=1) for c in centroids], axis=1).argmin(axis=1)
    else:
        best = np.zeros(len(m), np.int64)
    step = m.astype(np.int64) - centroids[best]
    return best, (step * step).sum(axis=1)


def settle(batch: pa.RecordBatch, row: int, centroids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of a block and, if there are several, its vectors (else an empty matrix)."""
    lo, hi = (np.frombuffer(batch.column(c)[row].as_py(), np.int32) for c in ("lo", "hi"))
    able = candidates(lo, hi, centroids)
    if len(able) == 1:
        return able, np.zeros((0, size), np.int32)
    return able, np.frombuffer(batch.column("vectors")[row].as_py(), np.int32).reshape(-1, size)


def step(zones: DataFrame, centroids: np.ndarray, p: Clustering) -> np.ndarray:
    """Centroids of the next round: exact floors of the means; a cluster without vectors keeps its own."""
    size, k = p.size, len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                able, m = settle(batch, row, centroids, size)
                if len(able) == 1:
                    n[able[0]] += batch.column("n")[row].as_py()
                    total[able[0]] += np.frombuffer(batch.column("total")[row].as_py(), np.int64)
                    continue
                best = able[nearest(m, centroids[able])[0]]
                n += np.bincount(best, minlength=k)
                for c in able:
                    total[c] += m[best == c].sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), pa.array(list(total), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = zones.select("lo", "hi", "total", "n", "vectors").mapInArrow(run, "cluster long, n long, total array<long>")
    sums = [F.sum(F.col("total")[i]).alias(f"_{i}") for i in range(size)]
    moved = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        if r["n"]:
            moved[r["cluster"]] = [r[f"_{i}"] // r["n"] for i in range(size)]
    return moved


def assigned(zones: DataFrame, centroids: np.ndarray, p: Clustering) -> DataFrame:
    """`vec_id`, `cluster`, `distance` of every vector; `candidates`: how many centroids its block left."""
    size = p.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                able, _ = settle(batch, row, centroids, size)
                m = np.frombuffer(batch.column("vectors")[row].as_py(), np.int32).reshape(-1, size)
                best, far = nearest(m, centroids[able])
                ids = np.frombuffer(batch.column("vec_ids")[row].as_py(), np.int64)
                named = np.frombuffer(batch.column("has_id")[row].as_py(), bool)
                columns = [pa.array(ids, mask=~named), pa.array(able[best].astype(np.int32)), pa.array(far), pa.array(np.full(len(m), len(able), np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "candidates"])

    return zones.select("vec_ids", "has_id", "lo", "hi", "vectors").mapInArrow(run, "vec_id long, cluster int, distance long, candidates int")


def cluster(vectors: DataFrame, p: Clustering = Clustering()) -> tuple[DataFrame, np.ndarray]:
    """Rows of `assigned` for every kept vector, and the final centroids.

    Left out are null vectors, vectors of another length, and vectors with a null or non-finite component.  A
    vector without an id takes part, but starts a cluster only where fewer than `k` have one; rows that occur again count again.  With fewer
    vectors than `k` there are fewer centroids; an empty table gives no rows.  Equally near centroids: the
    smaller number.  A component beyond 2^27 after scaling is an error, as its distances would not fit into a long.
    """
    rows = kept(vectors, p)
    centroids = first_centroids(rows, p)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, candidates int"), centroids
    zones = blocks(rows, p)
    for _ in range(p.rounds):
        centroids = step(zones, centroids, p)
    return assigned(zones, centroids, p), centroids


def cluster_report(vectors: DataFrame, p: Clustering = Clustering()) -> DataFrame:
    """`cluster` with `cluster_inertia`, `inertia` and the hash of each final centroid.

    One row per kept vector (see `cluster` for nulls, ties, repeated rows and empty tables).
    """
    found, centroids = cluster(vectors, p)
    rows = materialise(found, "assigned")
    digest = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    names = vectors.sparkSession.createDataFrame(digest, "cluster int, centroid_sha256 string")
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(F.broadcast(names), "cluster")
    total = rows.agg(F.sum("distance").alias("inertia"))
    # At most k rows and one row.
    return (
        rows.join(F.broadcast(inertia), "cluster")
        .crossJoin(F.broadcast(total))
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "candidates")
    )


def _op11_sql(p: Clustering = Clustering()) -> str:
    """The contract as plain SQL: one pair of tables for each round."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({p.scale} * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE len(embedding) = {p.size} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT r, i, q[i] AS x FROM kept, range(1, {p.size + 1}) t(i))",
        f"""start AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q
  FROM (SELECT sha256('{p.seed}:' || vec_id) AS h, q FROM kept ORDER BY h, q LIMIT {p.k}))""",
        f"c0 AS MATERIALIZED (SELECT c, i, q[i] AS y FROM start, range(1, {p.size + 1}) t(i))",
    ]
    for k in range(p.rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS m
  FROM (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS d FROM parts JOIN c{k} USING (i) GROUP BY r, c) GROUP BY r)"""
        )
        if k < p.rounds:
            steps.append(
                f"""c{k + 1} AS MATERIALIZED (
  SELECT old.c, old.i, coalesce((s - ((s % n) + n) % n) // n, old.y)::BIGINT AS y
  FROM c{k} old LEFT JOIN (
    SELECT m.c AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN parts USING (r) GROUP BY m.c, i) new USING (c, i))"""
            )
    last = f"a{p.rounds}"
    return f"""WITH {", ".join(steps)},
names AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS h FROM c{p.rounds} GROUP BY c)
SELECT kept.vec_id, m.c::INTEGER AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia,
  sum(m.d) OVER ()::BIGINT AS inertia, names.h AS centroid_sha256
FROM kept JOIN {last} USING (r) JOIN names ON names.c = m.c"""


OP11_SQL = _op11_sql()
