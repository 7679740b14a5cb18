"""Centroid clustering of integer vectors in column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Components beyond this could carry a column sum out of 64 bits; they fail the query instead of giving wrong sums.
MOST = 1 << 26


def whole_vectors(vectors: DataFrame, id_: str, vector: str, dims: int, scale: float) -> DataFrame:
    """(vec_id, x): ``floor(scale * component)`` of the vectors that have ``dims`` finite components."""
    v = F.col(vector).cast("array<double>")
    sound = F.coalesce(F.size(v) == dims, F.lit(False)) & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    fits = lambda c: F.when(F.abs(c) < MOST, F.floor(c)).otherwise(F.raise_error(F.lit("a component is too large for exact sums")).cast("long"))
    return vectors.filter(sound).select(F.col(id_).cast("long").alias("vec_id"), F.transform(v, lambda c: fits(c * F.lit(float(scale)))).alias("x"))


def nearest(x: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid by squared distance, ties to the smaller number.

    The distance is that of x from zero plus the sum of c * (c - 2x); the literal arrays hold one such c each, so
    a component costs one product. All are integers, exact or an overflow error.
    """
    def total(products: Column) -> Column:
        return F.aggregate(products, F.lit(0).cast("long"), lambda s, p: s + p)

    # written out as text: one call to the engine instead of one per component
    rows = ", ".join(f"struct({sum(v * v for v in c)}L AS square, array({', '.join(f'{-2 * v}L' for v in c)}) AS twice)" for c in centroids)
    apart = lambda c: total(F.zip_with(x, c["twice"], lambda a, b: a * b)) + c["square"]
    least = F.array_min(F.transform(F.expr(f"array({rows})"), lambda c, i: F.struct(apart(c).alias("rest"), i.alias("cluster"))))
    return F.struct((least["rest"] + total(F.transform(x, lambda a: a * a))).alias("distance"), least["cluster"].alias("cluster"))


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the exact floor of every column's mean; one without vectors stays.

    Sums are combined before the shuffle, so one row per cluster and task is moved, however uneven the clusters are.
    """
    near = rows.select(nearest(F.col("x"), centroids)["cluster"].alias("cluster"), "x")
    sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))])
    out = list(centroids)
    for r in sums.collect():
        out[r["cluster"]] = [s // r["n"] for s in r[2:]]
    return out


def clusters(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    A vector takes part if it has ``dims`` components, none null or non-finite; they become ``floor(scale * x)``, and all that follows is
    integer arithmetic. The first centroids are the ``k`` vectors with the smallest sha256 of ``seed:vec_id``. Each of ``rounds``
    rounds assigns every vector to the nearest centroid (squared distance, ties to the smaller number) and replaces each centroid that has
    vectors by the floor of their mean, component by component; then all vectors are assigned once more.

    Only centroids, and sums of ``k`` rows, reach the driver. Rounds read the vectors where they lie and shuffle ``k`` rows a task.

    Rows that repeat an id all take part; where hashes tie, the lesser vector comes first. A null id hashes after all others. With fewer than ``k`` vectors each
    is a centroid, and centroids that repeat leave all but the first of them empty. Scaled components of 2^26 or more fail the query.
    Other columns are left out. An empty table gives no rows.
    """
    rows = whole_vectors(vectors, id_, vector, dims, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centroids = [r["x"] for r in rows.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()]
    if not centroids:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    held = stage(rows.select("vec_id", nearest(F.col("x"), centroids).alias("p")).select("vec_id", "p.cluster", "p.distance"))
    sums = {r["cluster"]: int(r["s"]) for r in held.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.lit(values).cast(f"array<{kind}>"), F.col("cluster"))
    return held.select(
        "vec_id", "cluster", "distance", of([sums.get(i, 0) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256"),
    )
