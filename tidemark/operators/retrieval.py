"""Keyword ranking, hashed n-gram vectors and cosine search, many queries at once.

Texts and vectors are never moved: a task takes them as the scan gives them, and the queries come to the
task, block by block, from a table in the shared folder. What is shuffled are the k
best per query of each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import SPACE_RUN, tokens
from ..session import shared_dir

# Term saturation and length weight of the ranking.
K1, B = 1.5, 0.75
DIM = 512
BLOCK = 256  # queries that a task holds at a time
ROWS = 1024  # texts or vectors that a task has as a matrix at a time, however many a batch brings
SCORED = 256  # texts that a task scores at a time: their pairs with queries may be many times their terms
CHARACTERS = 1 << 18  # of texts whose pairs a task counts at a time


def _shared(df: DataFrame) -> str:
    """Write a table to the shared folder; its URI."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return path if ":" in path.split("/")[0] else f"file://{path}"


def _blocks(uri: str, rows: int) -> Iterator[pa.RecordBatch]:
    """A staged table in bounded batches, read inside a task."""
    store, base = fs.FileSystem.from_uri(uri)
    for batch in ds.dataset(base, filesystem=store, format="parquet").to_batches(batch_size=rows):
        if batch.num_rows:
            yield batch


class _Asked:
    """The staged queries of a task, block by block, with the k best of each so far.

    Blocks up to ``most`` bytes stay in memory; more of them are read again for every batch of texts. What a task
    hands on is k rows per query, however many batches it has met.
    """

    def __init__(self, uri: str, k: int, most: int = 1 << 27):
        self.uri, self.k, self.best = uri, k, {}
        self.held: list | None = []
        size = 0
        for block in _blocks(uri, BLOCK):
            size += block.nbytes
            if size > most:
                self.held = None
                break
            self.held.append(block)

    def __iter__(self) -> Iterator[tuple[int, pa.RecordBatch]]:
        return enumerate(self.held if self.held is not None else _blocks(self.uri, BLOCK))

    def add(self, number: int, q: np.ndarray, names: np.ndarray, score: np.ndarray) -> None:
        """Take in candidates of block ``number``; near-equal scores are rounded alike by the caller and go by name."""
        if number in self.best:
            q, names, score = (np.concatenate([x, y]) for x, y in zip(self.best[number], (q, names, score)))
        order = np.lexsort((names, -np.round(score, 9), q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = order[place < self.k]
        self.best[number] = (q[place < self.k], names[keep], score[keep])

    def rows(self, kind: pa.DataType, columns: list[str]) -> Iterator[pa.RecordBatch]:
        for number, block in self:
            if number in self.best:
                q, names, score = self.best[number]
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(q)), pa.array(names, kind), pa.array(score)], names=columns)


def _best(scores: DataFrame, query: str, doc: str, k: int) -> DataFrame:
    """The k best per query; near-equal scores (1e-9) go by document."""
    w = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), doc)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _kept(score: np.ndarray, names: np.ndarray, k: int, positive: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(query row, positions of its k best): a partition by score, then only what reaches the k-th is sorted."""
    for q, row in enumerate(score):
        at = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
        if positive:
            at = at[row[at] > 0]
        if len(at):
            yield q, at[np.lexsort((names[at], -row[at]))[:k]]


def bm25(documents: DataFrame, doc: str, text: Column, queries: DataFrame, query: str, query_text: Column, k: int = 4) -> DataFrame:
    """(query, doc, score, rank): repeated query terms count as often as they occur.

    One aggregate gives the number of texts per term, with the counts of a task combined before the shuffle; the
    terms of each query with their weights go to the shared folder. A task then counts
    the terms of its own texts and scores them against all queries; a text without a term of the query has no score.
    """
    held = documents.select(F.col(doc), tokens(text).alias("_t"))
    size = held.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("_t")), F.lit(1.0)).alias("avg")).first()
    asked = queries.select(F.col(query), F.explode(tokens(query_text)).alias("term")).groupBy(query, "term").agg(F.count("*").alias("_times"))
    seen = held.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("_df"))
    weight = F.col("_times") * F.ln(1 + (F.lit(size["n"]) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    # a query's terms are bounded by its own text
    weights = asked.join(seen, "term").groupBy(query).agg(F.collect_list(F.struct("term", weight.alias("w"))).alias("terms"))
    uri, average = _shared(weights.select(F.col(query).alias("q"), F.col("terms.term").alias("term"), F.col("terms.w").alias("w"))), size["avg"]
    kinds, names = dict(documents.dtypes), dict(queries.dtypes)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, kind = _Asked(uri, k), None
        for whole in batches:
            kind = whole.schema.field(0).type
            for a in range(0, whole.num_rows, SCORED):
                part = whole.slice(a, SCORED)
                listed = part.column(1)
                length = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                owner, words = np.repeat(np.arange(len(part)), length), listed.flatten()
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for number, block in queries:
                    terms = block.column(1)
                    known = pc.unique(terms.flatten())
                    at = pc.index_in(words, known).fill_null(-1).to_numpy(zero_copy_only=False)
                    cell, tf = np.unique((owner * len(known) + at)[at >= 0], return_counts=True)
                    d, term = cell // len(known), cell % len(known)
                    sat = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[d] / average))
                    # the queries of every term, one after another
                    own = np.repeat(np.arange(len(block)), terms.value_lengths().to_numpy(zero_copy_only=False))
                    of = pc.index_in(terms.flatten(), known).to_numpy(zero_copy_only=False)
                    order = np.argsort(of, kind="stable")
                    own, w = own[order], block.column(2).flatten().to_numpy(zero_copy_only=False)[order]
                    first = np.searchsorted(of[order], np.arange(len(known) + 1))
                    many = np.diff(first)[term]
                    pair = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[:-1][term], many)
                    score = np.bincount(own[pair] * len(part) + np.repeat(d, many), np.repeat(sat, many) * w[pair], len(block) * len(part)).reshape(len(block), len(part))
                    rows = [(q, best) for q, best in _kept(np.round(score, 9), ids, k, True)]
                    if rows:
                        qs = np.repeat([q for q, _ in rows], [len(b) for _, b in rows])
                        ds_ = np.concatenate([b for _, b in rows])
                        queries.add(number, qs, ids[ds_], score[qs, ds_])
        yield from queries.rows(kind, [query, doc, "score"])

    return _best(held.mapInArrow(local, f"{query} {names[query]}, {doc} {kinds[doc]}, score double"), query, doc, k)


def packed(df: DataFrame, doc: str, text: Column, dim: int = DIM) -> DataFrame:
    """(doc, buckets, weights): counts of characters and of pairs of them in ``dim`` buckets of a portable hash, scaled to length one.

    Counted for some texts at a time within the scan: only different pairs are hashed, one by one. A text without characters has no row.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[int, int] = {}
        for batch in batches:
            long = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            a = 0
            while a < batch.num_rows:
                # whole texts up to a number of characters; a longer one comes alone
                z = max(a + 1, a + int(np.searchsorted(np.cumsum(long[a:a + ROWS]), CHARACTERS, "right")))
                full = a + np.flatnonzero(long[a:z])
                n = long[full]
                a, texts = z, batch.column(1).slice(a, z - a)
                if not len(full):
                    continue
                codes = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), np.uint32).astype(np.int64)
                owner = np.repeat(np.arange(len(full)), n)
                inner = owner[1:] == owner[:-1]
                gram, where = np.concatenate([codes, (codes[:-1] + 1 << 21 | codes[1:])[inner]]), np.concatenate([owner, owner[1:][inner]])
                kinds, of = np.unique(gram, return_inverse=True)
                cell = np.array([place.get(g, -1) for g in kinds.tolist()])
                for i in np.flatnonzero(cell < 0):
                    g = int(kinds[i])
                    written = chr(g) if g < 1 << 21 else chr((g >> 21) - 1) + chr(g & (1 << 21) - 1)
                    cell[i] = place[g] = int(hashlib.md5(written.encode()).hexdigest()[:8], 16) % dim
                if len(place) > 1 << 18:
                    place.clear()
                counts = np.bincount(where * dim + cell[of], minlength=len(full) * dim).reshape(len(full), dim).astype(float)
                del codes, owner, inner, gram, where, of
                row, at = np.nonzero(counts)
                weight = (counts / np.sqrt((counts * counts).sum(axis=1, keepdims=True)))[row, at]
                ends = pa.array(np.searchsorted(row, np.arange(len(full) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full)), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight))], names=[doc, "buckets", "weights"])

    squeezed = df.select(F.col(doc), F.regexp_replace(text, SPACE_RUN, "").alias("_t"))
    return squeezed.mapInArrow(local, f"{doc} {dict(df.dtypes)[doc]}, buckets array<int>, weights array<double>")


def hashed_vectors(df: DataFrame, doc: str, text: Column, dim: int = DIM) -> DataFrame:
    """(doc, bucket, weight): the cells of :func:`packed`, one per row."""
    cell = F.explode(F.arrays_zip("buckets", "weights"))
    return packed(df, doc, text, dim).select(doc, cell.alias("_c")).select(doc, F.col("_c.buckets").alias("bucket"), F.col("_c.weights").alias("weight"))


def _matrix(columns: list[pa.Array], dim: int) -> np.ndarray:
    """Rows of unit length from dense arrays, or from (positions, weights) arrays."""
    if len(columns) == 1:
        x = np.array(columns[0].to_pylist(), dtype=float)
    else:
        x = np.zeros((len(columns[0]), dim))
        row = np.repeat(np.arange(len(x)), columns[0].value_lengths().to_numpy(zero_copy_only=False))
        x[row, columns[0].flatten().to_numpy(zero_copy_only=False)] = columns[1].flatten().to_numpy(zero_copy_only=False)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def cosine_topk(vectors: DataFrame, doc: str, vector: list[str], queries: DataFrame, query: str, query_vector: list[str], k: int = 4, dim: int = DIM) -> DataFrame:
    """(query, doc, score, rank) by cosine, exact. A vector is one dense array column, or positions and weights.

    One pass over the vectors: each batch meets the staged queries block by block and keeps
    its k best per query, so what is shuffled is k rows per query and task.
    """
    kinds, names = dict(vectors.dtypes), dict(queries.dtypes)
    uri = _shared(queries.select(query, *query_vector))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, kind = _Asked(uri, k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                held, ids = _matrix(part.columns[1:], dim), part.column(0).to_numpy(zero_copy_only=False)
                for number, block in asked:
                    score = np.round(_matrix(block.columns[1:], dim) @ held.T, 9)
                    rows = list(_kept(score, ids, k))
                    qs = np.repeat([q for q, _ in rows], [len(b) for _, b in rows])
                    best = np.concatenate([b for _, b in rows])
                    asked.add(number, qs, ids[best], score[qs, best])
        yield from asked.rows(kind, [query, doc, "score"])

    return _best(vectors.select(doc, *vector).mapInArrow(local, f"{query} {names[query]}, {doc} {kinds[doc]}, score double"), query, doc, k)
