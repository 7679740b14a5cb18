"""Exact top-k inner products by norm buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stage


class Bucket:
    """Vectors of similar length, the longest first, with the sorted directions that coordinate pruning needs."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        length = np.sqrt((x.astype(float) ** 2).sum(1))
        order = np.lexsort((ids, -length))
        self.ids, self.x, self.length = ids[order], x[order], length[order]
        self.unit = self.x / np.maximum(self.length, 1e-300)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def near(self, coordinate: int, low: float, high: float) -> np.ndarray:
        if coordinate not in self.sorted:
            rank = np.argsort(self.unit[:, coordinate], kind="stable")
            self.sorted[coordinate] = rank, self.unit[rank, coordinate]
        rank, values = self.sorted[coordinate]
        return rank[np.searchsorted(values, low, "left"):np.searchsorted(values, high, "right")]

    def candidates(self, q: np.ndarray, floor: float, focus: int, steep: float) -> np.ndarray | slice:
        """Positions that may reach the product ``floor`` with q.

        The local threshold is the cosine that the longest vector needs. Above ``steep`` each of the
        ``focus`` largest coordinates of q's direction leaves a narrow interval for the vector's own;
        below it, only the vectors long enough are taken.
        """
        norm = float(np.sqrt((q.astype(float) ** 2).sum()))
        if floor <= 0 or norm == 0:
            return slice(None)
        longest = self.length[0] if len(self.length) else 0.0
        local = floor / (norm * longest) if longest else np.inf
        if local > 1 + 1e-9:
            return np.zeros(0, np.int64)
        if local < steep:
            return slice(0, int(np.searchsorted(-self.length, -(floor / norm) * (1 - 1e-9), "right")))
        # the angle between vector and query is at most ``turn``, so their angles to an axis differ by no more
        turn, unit, left = float(np.arccos(min(local, 1.0))), q / norm, None
        for c in np.argsort(-np.abs(unit), kind="stable")[:focus]:
            axis = float(np.arccos(np.clip(unit[c], -1, 1)))
            got = self.near(int(c), np.cos(min(np.pi, axis + turn)) - 1e-9, np.cos(max(0.0, axis - turn)) + 1e-9)
            left = got if left is None else left[np.isin(left, got, assume_unique=True)]
        return left

    def products(self, q: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """Exact integer products of q with the vectors at some positions."""
        x = self.x[at]
        if not x.size:
            return np.zeros(len(x), np.int64)
        size = max(float(np.abs(q).max()), 1.0) * max(float(np.abs(x).max()), 1.0) * len(q)
        if size < 2.0 ** 53:
            return np.rint(x.astype(float) @ q.astype(float)).astype(np.int64)
        return x.astype(np.int64) @ q.astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


_TILE = "query_id long, vec_id long, score long"


def _blob(table: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """One row per group: ids and vectors as bytes. Groups are bounded by their number of rows."""
    def pack(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by(id_)
        x = np.array(part["x"].to_pylist(), np.int64)
        extra = {"floor": pa.array([np.array(part["floor"].to_pylist(), np.int64).tobytes()], pa.binary())} if "floor" in part.column_names else {}
        return pa.table({**{k: pa.array([v.as_py()], pa.int32()) for k, v in zip(keys, key)}, "ids": pa.array([np.array(part[id_].to_pylist(), np.int64).tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()), **extra})

    schema = ", ".join(f"{k} int" for k in keys) + ", ids binary, x binary" + (", floor binary" if "floor" in table.columns else "")
    return table.groupBy(*keys).applyInArrow(pack, schema)


def _tiles(pairs: DataFrame, k: int, focus: int, steep: float) -> DataFrame:
    """The k best of every query within every bucket it meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qx, qf, ci, cx in zip(*[batch.column(n) for n in range(5)]):
                qi, qf, ci = (np.frombuffer(v.as_buffer(), np.int64) for v in (qi, qf, ci))
                qx = np.frombuffer(qx.as_buffer(), np.int64).reshape(len(qi), -1)
                bucket = Bucket(ci, np.frombuffer(cx.as_buffer(), np.int64).reshape(len(ci), -1))
                out: list[list[np.ndarray]] = [[], [], []]
                for q, x, floor in zip(qi, qx, qf):
                    at = bucket.candidates(x, float(floor), focus, steep)
                    ids, scores = bucket.ids[at], bucket.products(x, at)
                    fit = (ids != q) & (scores >= floor)
                    ids, scores = ids[fit], scores[fit]
                    top = best(ids, scores, k)
                    for c, v in zip(out, (np.full(len(top), q), ids[top], scores[top])):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return pairs.select("qi", "qx", "qf", "ci", "cx").mapInArrow(run, _TILE)


def _rank(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, query: Column, id_: str = "vec_id", vector: str = "embedding", scale: float = 64.0, k: int = 20,
          bucket_rows: int = 4096, query_rows: int = 1024, focus: int = 3, steep: float = 0.85) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query, exact, ties to the smaller id.

    Components become floor(scale * x). Rows for which ``query`` holds are queries, all rows
    candidates but the query's own id. Candidates are grouped by length into buckets of about
    ``bucket_rows``, queries into blocks of ``query_rows``. A first round over the bucket of the
    longest vectors gives every query a floor, its k-th best so far; then a block meets only the
    buckets whose longest vector can still reach a floor of the block. Within a bucket see :meth:`Bucket.candidates`; what is left is verified by exact products.

    Vectors that are null, or hold nulls or non-finite values, take no part, nor do rows with a
    null id; vectors of another dimension than the query's are not compared. A repeated id keeps the least of its vectors. With fewer candidates
    than k all are returned. Other columns are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    held = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("is_query"))
    sound = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = held.filter(sound).select("id", "is_query", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))
    x = x.groupBy("id").agg(F.min(F.struct("x", "is_query")).alias("m")).select("id", "m.x", "m.is_query", F.size("m.x").alias("dim"))
    x = stage(x.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))))
    count = x.count()
    buckets = max(1, -(-count // bucket_rows))
    # up to 1024 lengths reach the driver; beyond that, and where lengths are equal, a bucket is dealt into parts
    cuts = min(buckets, 1024)
    points = sorted({-p for p in x.approxQuantile("norm", [i / cuts for i in range(1, cuts)], 0.1 / cuts)}) if cuts > 1 else []
    levels = F.array(*[F.lit(-p) for p in points]) if points else F.array().cast("array<double>")
    level = F.size(F.filter(levels, lambda p: F.col("norm") < p))
    numbered = x.withColumn("level", level.cast("int"))
    per = numbered.groupBy("dim", "level").agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    parts = F.ceil(F.col("n") / bucket_rows).cast("int")
    dealt = numbered.join(per.select("dim", "level", parts.alias("parts")), ["dim", "level"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    candidates = stage(_blob(dealt.select("dim", "level", "part", "id", "x"), ["dim", "level", "part"], "id").select("dim", "level", "part", F.col("ids").alias("ci"), F.col("x").alias("cx")))
    asked = numbered.filter("is_query").select("dim", "id", "x", "norm")
    blocks = max(1, -(-asked.count() // query_rows))
    # queries of similar length and floor have no common order, so blocks are dealt by hash
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    top = candidates.join(per.groupBy("dim").agg(F.min("level").alias("level")), ["dim", "level"]).filter("part = 0")
    lowest = np.iinfo(np.int64).min
    seed = _blob(asked.withColumn("floor", F.lit(lowest)).select("dim", "block", "id", "x", "floor"), ["dim", "block"], "id")
    named = [F.col("ids").alias("qi"), F.col("x").alias("qx"), F.col("floor").alias("qf")]
    seeded = _tiles(seed.select("dim", "block", *named).join(top, "dim"), k, focus, steep)
    floors = seeded.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("s")).filter(F.col("c") >= k)
    ready = stage(asked.join(floors, asked["id"] == floors["query_id"], "left").select("dim", "block", "id", "x", "norm", F.coalesce("s", F.lit(lowest)).alias("floor")))
    release(spark)
    reach = ready.groupBy("dim", "block").agg(F.min(F.when(F.col("floor") > 0, F.col("floor") / F.greatest("norm", F.lit(1e-300))).otherwise(0.0)).alias("need"))
    meets = reach.join(per, "dim").filter(F.col("longest") >= F.col("need") * (1 - 1e-9)).select("dim", "block", "level")
    blobs = _blob(ready.select("dim", "block", "id", "x", "floor"), ["dim", "block"], "id").select("dim", "block", *named)
    pairs = meets.join(candidates, ["dim", "level"]).join(blobs, ["dim", "block"])
    found = _tiles(pairs, k, focus, steep)
    return _rank(found, k).select("query_id", "rank", "vec_id", "score")
