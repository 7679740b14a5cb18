"""A quality classifier: histogram gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytes_text import SPACE, column, slices, word_bounds, word_hashes
from .common import stage

FEATURES = ("log_bytes", "log_words", "word_bytes", "word_spread", "longest_word", "upper", "digits", "blank", "breaks", "wide", "stops", "marks",
            "bars", "symbols", "shouts", "short_words", "different_words", "top_word", "different_lines", "line_bytes", "capital_words", "marked_words", "repeated_pairs")


def _classes() -> np.ndarray:
    """Byte classes, one row per class."""
    rows = {
        "upper": range(65, 91), "digits": range(48, 58), "blank": b" \t", "breaks": b"\n\r", "wide": range(128, 256),
        "stops": b".,;:", "marks": b"'\"()-?", "bars": b"|<>/\\_=~^[]{}", "symbols": b"#$%&*@+`", "shouts": b"!",
    }
    out = np.zeros((len(rows), 256))
    for i, b in enumerate(rows.values()):
        out[i, list(b)] = 1
    return out


_CLASSES = _classes()


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) of whole texts; an empty text is all zero but for its ratios of different words and lines, which are one."""
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i, j, b, o in slices(buf, offsets):
        n, size = j - i, np.diff(o)
        starts, ends, first = word_bounds(b, o)
        h, _ = word_hashes(b, o)
        words, width = np.diff(first), (ends - starts).astype(float)
        doc = np.repeat(np.arange(n), words)
        per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
        hist = np.bincount(np.repeat(np.arange(n), size) * 256 + b, minlength=n * 256).reshape(n, 256)
        shares = (hist @ _CLASSES.T) / per_byte[:, None]
        mean = np.bincount(doc, width, n) / per_word
        spread = np.sqrt(np.maximum(np.bincount(doc, width * width, n) / per_word - mean * mean, 0))
        last = b[ends - 1] if len(ends) else b[:0]
        capital = (b[starts] >= 65) & (b[starts] <= 90) if len(starts) else np.zeros(0, bool)
        marked = ~(((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | ((last >= 48) & (last <= 57)) | (last >= 128))
        lines = np.flatnonzero(b == 10)
        line_ends = np.searchsorted(lines, o)
        f = out[i:j]
        f[:, 0], f[:, 1], f[:, 2], f[:, 3] = np.log1p(size), np.log1p(words), mean, spread
        f[:, 5:15] = shares
        f[:, 15] = np.bincount(doc, width <= 3, n) / per_word
        f[:, 20], f[:, 21] = np.bincount(doc, capital, n) / per_word, np.bincount(doc, marked, n) / per_word
        f[:, 19] = np.log1p(size / (np.diff(line_ends) + 1))
        # lines as sums of their words' hashes
        row = np.searchsorted(lines, starts) if len(starts) else starts
        for d in range(n):
            a, z = first[d], first[d + 1]
            if a == z:
                f[d, [16, 18]] = 1
                continue
            mine = h[a:z]
            sorted_ = np.sort(mine)
            edges = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]]))
            runs = np.diff(edges)
            f[d, 4], f[d, 16], f[d, 17] = width[a:z].max(), len(runs) / (z - a), runs.max() / (z - a)
            begin = np.flatnonzero(np.concatenate([[True], row[a + 1:z] != row[a:z - 1]]))
            sums = np.add.reduceat(mine * np.uint64(3) ^ (mine >> np.uint64(7)), begin)
            f[d, 18] = len(np.unique(sums)) / len(sums)
            pairs = mine[:-1] * np.uint64(5) + mine[1:]
            f[d, 22] = 1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0
    return out


@dataclass
class Trees:
    """All trees in flat arrays: node n of tree t lies at t * width + n, its children at 2n + 1 and 2n + 2."""

    start: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @property
    def width(self) -> int:
        return 2 ** (self.depth + 1) - 1

    def margin(self, x: np.ndarray) -> np.ndarray:
        """One step a level for all rows and trees at once; a leaf sends everything left."""
        trees = len(self.feature) // self.width
        base = np.arange(trees) * self.width
        out = np.full(len(x), self.start)
        for a in range(0, len(x), 512):
            rows = np.arange(min(512, len(x) - a))[:, None]
            part = x[a:a + 512]
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(self.depth):
                at = base + node
                node = 2 * node + 1 + (part[rows, self.feature[at]] > self.threshold[at])
            out[a:a + 512] += self.value[base + node].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, smooth: float = 1.0, least: float = 1.0) -> Trees:
    """Boosting on the logistic loss. Features are cut into at most ``bins`` bins at quantiles; splits are found on histograms of gradients.

    Without rows the score is 0.5 everywhere, with one class only it is close to that class.
    """
    n, m = x.shape
    prior = (y.sum() + 0.5) / (n + 1.0)
    width = 2 ** (depth + 1) - 1
    model = Trees(float(np.log(prior / (1 - prior))), depth, np.zeros(trees * width, np.int64), np.full(trees * width, np.inf), np.zeros(trees * width))
    if n == 0 or y.min() == y.max():
        model.feature, model.threshold, model.value = model.feature[:width], model.threshold[:width], model.value[:width]
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    coded = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    cell = coded + np.arange(m) * bins
    margin = np.full(n, model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth + 1):
            first, count = 2 ** level - 1, 2 ** level
            local = node - first
            at = t * width + first + np.arange(count)
            if level == depth:
                G, H = np.bincount(local, g, count), np.bincount(local, h, count)
                model.value[at] = -rate * G / (H + smooth)
                break
            flat = (local[:, None] * (m * bins) + cell).ravel()
            G = np.bincount(flat, np.repeat(g, m), count * m * bins).reshape(count, m, bins).cumsum(2)
            H = np.bincount(flat, np.repeat(h, m), count * m * bins).reshape(count, m, bins).cumsum(2)
            Gt, Ht = G[:, :1, -1:], H[:, :1, -1:]
            gain = G * G / (H + smooth) + (Gt - G) ** 2 / (Ht - H + smooth) - Gt * Gt / (Ht + smooth)
            gain[(H < least) | (Ht - H < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            good = gain.reshape(count, -1).max(1) > 1e-9
            f, cut = best // bins, best % bins
            model.feature[at] = np.where(good, f, 0)
            model.threshold[at] = [edges[a][c] if ok and c < len(edges[a]) else np.inf for a, c, ok in zip(f, cut, good)]
            node = 2 * node + 1 + (x[np.arange(n), model.feature[t * width + node]] > model.threshold[t * width + node])
        margin += model.value[t * width + node]
    return model


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = statistics(*column(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=[*keep, "f"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(local, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", f array<double>")


def train(docs: DataFrame, labels: DataFrame, usable: Column, doc: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 20_000) -> Trees:
    """Trees from at most ``sample_rows`` labelled rows for which ``usable`` (over the id column) holds.

    The bound is a parameter of the fit: the rows are those with the smallest hash of their id, so
    more documents mean another sample, not a larger one. Only their statistics, ``sample_rows``
    short arrays, reach the driver. Labels other than 0 and 1 and null ids are left out; of
    contradicting labels of an id the smaller counts.
    """
    named = labels.select(F.col(doc).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    named = named.filter(usable).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    named = stage(named)
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # at most sample_rows short rows are broadcast
    rows = _measured(source.join(F.broadcast(named), "doc_id"), ["doc_id", "y"]).dropDuplicates(["doc_id"]).orderBy("doc_id").limit(sample_rows).collect()
    x = np.array([r["f"] for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, model: Trees, text: str = "text", name: str = "quality_score") -> DataFrame:
    """``docs`` with the score in a further column ``name`` (replacing one of that name): one pass over the rows, without a shuffle.

    Null and empty texts are scored by the statistics of the empty text.
    """
    def local(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(*column(texts))))

    return docs.withColumn(name, F.arrow_udf(local, "double")(F.col(text).cast("string")))
