"""Placement of documents on shards by a hierarchical weighted hash tree, in DataFrame functions only."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    region: str
    rack: str
    number: int
    weight: float = 1.0


def layout(shards: int = 8, racks: int = 2, regions: int = 2) -> list[Shard]:
    """``shards`` shards numbered from 0, dealt evenly over the racks of the regions."""
    each = max(1, -(-shards // (racks * regions)))
    return [Shard(f"r{n // (each * racks)}", f"k{n // each}", n) for n in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region of its own: only a new subtree changes its weight, so rows move into the new shard alone."""
    number = max(s.number for s in tree) + 1
    return [*tree, Shard(f"new{number}", f"new{number}", number, weight)]


def _children(tree: list[Shard]) -> Column:
    """Map from a node of the tree to its children with their weights; a subtree weighs what its shards do, weights of 0 are left out."""
    below: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for s in tree:
        if s.weight > 0:
            path = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.number}"]
            for parent, child in zip(path, path[1:]):
                below[parent][child] += s.weight
    pairs = []
    for parent, children in below.items():
        pairs += [F.lit(parent), F.array(*[F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight")) for n, w in children.items()])]
    return F.create_map(*pairs)


def _draw(key: Column, node: Column, weight: Column) -> Column:
    """An exponential draw of rate ``weight`` that key and node decide: among several, each is the smallest in proportion to its weight."""
    uniform = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), node)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.ln(uniform) / weight


def place(df: DataFrame, key: str, tree: list[Shard], name: str) -> DataFrame:
    """``df`` with the number of the shard of column ``key``: from the root down, the child with the smallest draw."""
    below, at = _children(tree), F.lit("")
    for level in ("region", "rack", "leaf"):
        draws = F.transform(F.element_at(below, at), lambda c: F.struct(_draw(F.col(key), c["node"], c["weight"]).alias("d"), c["node"].alias("node")))
        df = df.withColumn(f"_{name}_{level}", F.array_min(draws)["node"])
        at = F.col(f"_{name}_{level}")
    number = F.substring_index(at, "/", -1).cast("int")
    return df.withColumn(name, number).drop(*[f"_{name}_{level}" for level in ("region", "rack", "leaf")])


def shard(docs: DataFrame, tree: list[Shard], doc: str = "doc_id", text: str = "text", rows_per_bucket: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard for every row.

    ``shard`` depends on the id and the tree alone, ``grown_shard`` on the id and the grown tree. ``size``: UTF-8
    bytes of the text plus 1, a null text counts as empty. ``slot`` numbers the rows of a
    shard from 0 without gaps, in the order of the id's digest, then of id and text.

    Numbers are given in two steps, within buckets of about ``rows_per_bucket`` rows (a bucket is a
    prefix of the digest) and by the sums of the buckets before. Rows equal in id and text are collapsed to a
    count per scan partition before, so a third of all rows being the same is no hot group.
    A null id is placed as the word null. Other columns are left out; an empty table gives no rows.
    """
    key = F.coalesce(F.col(doc).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(F.col(doc).cast("long").alias("doc_id"), key.alias("k"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    same = narrow.withColumn("part", F.spark_partition_id()).groupBy("doc_id", "k", "size", "text_crc32", "part").agg(F.count("*").alias("n"))
    placed = place(place(same.withColumn("digest", F.md5("k")), "k", tree, "shard"), "k", grown(tree), "grown_shard")
    rows, digits = max(1, docs.count()), 0
    while rows > rows_per_bucket * len(tree) * 16 ** digits:
        digits += 1
    placed = placed.withColumn("bucket", F.substring("digest", 1, digits) if digits else F.lit(""))
    sums = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("_n"))
    # one row per bucket reaches this window
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy("shard", "bucket").orderBy("digest", F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "part").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("_in", F.coalesce(F.sum("n").over(w), F.lit(0))).join(before, ["shard", "bucket"])
    start = F.col("_before") + F.col("_in")
    out = inner.select("doc_id", "size", "text_crc32", "shard", "grown_shard", F.explode(F.sequence(start, start + F.col("n") - 1)).alias("slot"))
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
