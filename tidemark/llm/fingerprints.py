"""Bottom-k sketches of documents: mergeable fingerprints that estimate likeness."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_text import U, byte_shingles, column, slices
from .common import partitions

#: Bits kept of a shingle's hash.
BITS = 48


def sketch(values: np.ndarray, k: int) -> np.ndarray:
    """The k smallest different values, ascending."""
    if len(values) > 4 * k:
        # repeats may stand among the smallest, so the cut is widened until it holds k different ones
        n = 2 * k
        while n < len(values):
            low = np.unique(np.partition(values, n - 1)[:n])
            if len(low) >= k:
                return low[:k]
            n *= 2
    return np.unique(values)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The sketch of two parts together."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int) -> float:
    """Estimated number of different shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0 ** BITS / float(a[-1] + U(1))


def resemblance(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated Jaccard likeness; 1 for two empty sketches, 0 for one."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    """Six bytes a value in base64."""
    return base64.b64encode(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel().astype(U)


def sketches(texts: pa.Array | pa.ChunkedArray, k: int, width: int) -> list[np.ndarray]:
    """One sketch per text over its runs of ``width`` bytes, shorter at its beginning, so that the shortest texts have some too; null and empty texts have an empty one."""
    buf, offsets = column(texts)
    out = []
    for _, _, b, o in slices(buf, offsets):
        h, bounds = byte_shingles(b, o, width)
        h >>= U(64 - BITS)
        out.extend(sketch(h[a:z], k) for a, z in zip(bounds[:-1], bounds[1:]))
    return out


def fingerprint(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 128, width: int = 12) -> DataFrame:
    """(doc_id, fingerprint, n_shingles): fingerprint text and estimated number of different shingles per row.

    Works within the scan, without a shuffle. Equal texts have equal fingerprints; null and
    empty texts have the empty one. Other columns are left out; an empty table gives no rows.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column(1), k, width)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fingerprint": pa.array(map(to_text, found), pa.string()), "n_shingles": pa.array([distinct_count(s, k) for s in found], pa.float64())})

    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(local, "doc_id long, fingerprint string, n_shingles double")


def with_next(docs: DataFrame, doc: str = "doc_id", text: str = "text", rows: int = 2_000) -> DataFrame:
    """Rows sorted within ranges of doc_id, every range followed by the first row of the next (``own`` false): (range, doc_id, text, own).

    The document after another one in the order of doc_id is then the next row of the same
    partition. The last range is followed by the very first row. Ranges hold about ``rows`` rows; only their bounds come to the driver.
    """
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ids = source.select("doc_id")
    count = ids.count()
    ranges = max(1, min(-(-count // rows), 50_000))
    points = ids.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    cuts = [float("-inf"), *sorted(set(points)), float("inf")]

    def placed(df: DataFrame) -> DataFrame:
        at = df.withColumn("_x", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
        at = Bucketizer(splits=cuts, inputCol="_x", outputCol="_r").transform(at) if len(cuts) > 2 else at.withColumn("_r", F.lit(0))
        return at.select(*df.columns, F.col("_r").cast("int").alias("range"))

    held = placed(source)
    # the smallest id of every range that has rows: as many numbers as ranges
    least = {r["range"]: r["m"] for r in placed(ids).groupBy("range").agg(F.min(F.struct("doc_id")).alias("m")).select("range", F.col("m.doc_id").alias("m")).collect()}
    names = sorted(least)
    # the row that follows a range: the first of the next one, after the last range that of the first
    before = [(least[b], a) for a, b in zip(names, [*names[1:], *names[:1]])]
    spark = docs.sparkSession
    # as many rows as ranges
    firsts = F.broadcast(spark.createDataFrame(before, "first long, range int"))
    copies = source.join(firsts, F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", "range", F.lit(False).alias("own"))
    # of repeated smallest ids one copy is enough
    copies = copies.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("f")).select("f.doc_id", "f.text", "range", F.lit(False).alias("own"))
    every = held.withColumn("own", F.lit(True)).select("doc_id", "text", "range", "own").unionByName(copies.select("doc_id", "text", "range", "own"))
    return every.repartition(max(partitions(spark), len(names)), "range").sortWithinPartitions("range", F.col("own").desc(), "doc_id", "text").select("range", "doc_id", "text", "own")


def edit(text: str, following: str) -> str:
    """The last quarter of the characters gives way to the first as many of ``following``, or all it has."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def edited(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 128, width: int = 12) -> DataFrame:
    """Fingerprints of every text and of its edited form: doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    See :func:`edit`; the following text is that of the next larger doc_id, after the largest
    that of the smallest. One shuffle of the text, by ranges of doc_id. Likeness is the
    resemblance of the sketches. Ties of doc_id go by text, null ids come first; repeated rows stay.
    An empty text resembles only empty ones. An empty table gives no rows.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row whose follower has not been seen: (range, doc_id, text, sketch)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                own = sketches(part.column(2), k, width)
                rows = []
                for r, i, t, mine, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), own):
                    if last is not None and last[0] == r:
                        rows.append((*last[1:], t, s))
                    last = (r, i, t, s) if mine else None
                if not rows:
                    continue
                new = [edit(t, f) for _, t, _, f, _ in rows]
                changed = sketches(pa.array(new, pa.string()), k, width)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array(new, pa.string()),
                    pa.array([to_text(r[2]) for r in rows], pa.string()), pa.array(map(to_text, changed), pa.string()),
                    pa.array([resemblance(r[2], c, k) for r, c in zip(rows, changed)], pa.float64()), pa.array([resemblance(r[2], r[4], k) for r in rows], pa.float64()),
                ], names=["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, doc, text).mapInArrow(local, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
