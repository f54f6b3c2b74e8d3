"""Connected components of a large graph [X5].

Alternating large-star and small-star steps (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014): every step links neighbours of a node to the least
of them, until each component is a star around its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.skew import HOT_ROWS, heaviest, salted_join
from shutterlake.session import drop_path, fresh_path

MAX_ROUNDS = 60


def _with_least(adjacency: DataFrame, rows: int) -> DataFrame:
    """Adjacency rows (u, v) with `m`, the least of u and all its neighbours.

    The least node is a map-side combined aggregate.  Joining it back spreads hubs,
    unless the whole graph has fewer rows than a hub.
    """
    least = adjacency.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_degree"))
    named = least.select("u", F.least("u", "m").alias("m"))
    if rows < HOT_ROWS:
        return adjacency.join(named, "u")
    return salted_join(adjacency, named, ["u"], heaviest(least, ["u"], "_degree"), spread=["v"])


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _with_least(both, 2 * rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.filter("u <> v").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _with_least(down, rows)
    linked = starred.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
    return linked.filter("u <> v").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(hashed), F.sum(hashed.cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    The component is named after its least node.  Every round is written to the
    shared folder, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    current = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").distinct()
    path = fresh_path(spark, "components")
    current.write.parquet(path)
    current = spark.read.schema(current.schema).parquet(path)
    state = _fingerprint(current)
    for _ in range(MAX_ROUNDS):
        step = _small_star(_large_star(current, state[0]), state[0])
        written = fresh_path(spark, "components")
        step.write.parquet(written)
        current = spark.read.schema(step.schema).parquet(written)
        drop_path(spark, path)
        before, state, path = state, _fingerprint(current), written
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
