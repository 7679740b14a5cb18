"""Staging in the cluster's shared folder, and connected components without a driver-side graph."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, stage

__all__ = ["components", "discard", "partitions", "release", "spots", "stage", "within"]


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, for tables that are dealt by hand."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs: it does so once the driver has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spots(ids: DataFrame, column: str, most: int = 1 << 30, hashed: bool = False) -> tuple[np.ndarray, int]:
    """(bytes of a bitmap, number of bits): the spot ``xxhash64(id) mod number`` of every id is set; of ids that are ``hashed`` already their own.

    Tells inside a scan which rows an id list may hold, before anything is shuffled. Sixteen bits an id, never more than
    ``most``, so its size is bounded; a list too long for that lets more rows through that are not in it, and none is lost.
    """
    number = 1 << max(16, (16 * ids.count()).bit_length())
    number = min(number, most)
    spot = F.pmod(F.col(column) if hashed else F.xxhash64(column), F.lit(number)) + 1
    maps = ids.select(spot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    bits = np.zeros(number // 8, np.uint8)
    for r in maps:
        start = (r["b"] - 1) * len(r["m"])
        bits[start:start + len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    return bits, number


def within(table: DataFrame, column: str, ids: DataFrame, number: int) -> DataFrame:
    """Rows of ``table`` whose ``column`` may be in the first column of ``ids``, about ``number`` of them: all that are, and a few others.

    Nothing of ``table`` is shuffled: it meets a bitmap, sixteen bits an id and at most 8 MB, in parts of 4 KB.
    """
    size = min(1 << max(16, (16 * number).bit_length()), 1 << 26)
    spot = F.pmod(F.xxhash64(ids.columns[0]), F.lit(size)) + 1
    maps = ids.select(spot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("__b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__m"))
    # as numbers of 64 bits, made once a part: a row then reads one of them
    words = F.transform(F.sequence(F.lit(0), (F.octet_length("__m") / 8 - 1).cast("int")), lambda w: F.conv(F.hex(F.substring("__m", w * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    spot = F.pmod(F.xxhash64(column), F.lit(size)) + 1
    at = F.bitmap_bit_position(spot)
    # the first byte of a word is its highest
    bit = F.lit(56).bitwiseXOR(at.bitwiseAND(F.lit(63))).cast("int")
    held = table.withColumn("__b", F.bitmap_bucket_number(spot)).join(F.broadcast(maps.select("__b", words.alias("__m"))), "__b")
    return held.filter(F.getbit(F.get("__m", F.shiftrightunsigned(at, 6).cast("int")), bit) == 1).select(*table.columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): distributed union-find by alternating stars.

    Each round hangs the larger neighbours of every node under its smallest one, then
    does the same with the smaller neighbours, until every component is a star around its
    smallest node, which is when no node with a smaller neighbour has a second one: rounds grow with the
    logarithm of the longest chain. Rounds are tables in the shared folder; a node with many links is split
    by the adaptive join. No row reaches the driver.
    """
    pairs = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.max("b").alias("x")))
        if least.filter("m < a AND m < x").isEmpty():
            break
        large = pairs.join(least.select(F.col("a").alias("b"), "m"), "b").select("a", F.col("m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
        before, pairs = pairs, stage(small.filter("a <> b").distinct())
        discard(before, least)
    return least.select(F.col("a").alias("node"), F.col("m").alias("component"))
