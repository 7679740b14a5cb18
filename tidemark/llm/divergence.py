"""How the sources of every language differ in their terms: a frequent-pattern tree over the counts of terms by source."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytes_text import LOWER, U, column, hashes, mix, slices, word_bounds
from .common import spots, stage

#: Bytes between terms: all of ASCII but its letters.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
UNIT = 1_000_000_000


def _name(text: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little"))


def _names(values: pa.Array) -> np.ndarray:
    """A hash of every value of a string column."""
    coded = values.dictionary_encode()
    return np.array([_name(v) for v in coded.dictionary.to_pylist()], U)[coded.indices.to_numpy(zero_copy_only=False)]


def _runs(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first place, places, documents) of every different key; documents ascend."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    new = np.concatenate([np.ones(1, bool), k[1:] != k[:-1]])
    other = new.copy()
    other[1:] |= d[1:] != d[:-1]
    at = np.flatnonzero(new)
    return k[at], order[at], np.diff(np.append(at, len(k))), np.add.reduceat(other.astype(np.int64), at)


def _terms(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts, ends, row, key) of all terms in slices of whole texts; the key is a hash of language and term."""
    buf, offsets = column(batch.column(2))
    tongue = _names(batch.column(0))
    for i, j, b, o in slices(buf, offsets, most):
        starts, ends, first = word_bounds(b, o, BETWEEN)
        if len(starts):
            row = np.repeat(np.arange(j - i), np.diff(first))
            yield i, b, starts, ends, row, mix(hashes(b, starts, ends) + tongue[i:j][row])


def term_rows(docs: DataFrame, least: int, most: int = 1 << 21) -> DataFrame:
    """(lang, term, items) of (lang, source, text): the non-zero counts of every term that ``least`` documents hold, in the order of the sources.

    Most terms are rare. A first pass counts documents under a hash of language and term; a second one, through a bitmap of at most 128 MB over the frequent hashes,
    counts only terms that may be kept, and decides on the terms themselves. Both count in slices of ``most`` bytes, combined before the shuffle.
    """
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, row, key in _terms(batch, most):
                k, _, _, held = _runs(key, row)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(held)], names=["k", "docs"])

    hashed = docs.select("lang", "source", "text").mapInArrow(frequent, "k long, docs long").groupBy("k").agg(F.sum("docs").alias("docs"))
    keys = stage(hashed.filter(F.col("docs") >= least).select("k"))
    bitmap, number = spots(keys, "k", hashed=True)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _names(batch.column(1))
            for i, b, starts, ends, row, key in _terms(batch, most):
                spot = (key & U(number - 1)).astype(np.int64)
                some = np.flatnonzero(bits.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
                if not len(some):
                    continue
                row, starts, ends = row[some], starts[some], ends[some]
                _, at, n, held = _runs(mix(key[some] + place[i:][row]), row)
                a, long = starts[at], (ends - starts)[at]
                edge = np.concatenate([np.zeros(1, np.int64), np.cumsum(long)])
                letters = LOWER[b[np.arange(edge[-1]) + np.repeat(a - edge[:-1], long)]]
                term = pa.StringArray.from_buffers(len(at), pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(letters))
                rows = pa.array(i + row[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), term, pa.array(n), pa.array(held)], names=["lang", "source", "term", "n", "docs"])

    counts = docs.select("lang", "source", "text").mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("items"))
    return rows.filter(F.col("docs") >= least).select("lang", "term", "items")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)) without rounding; null where there are no terms."""
    over = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    under = (total + 2 * terms).cast("decimal(20,0)")
    whole = F.call_function("div", over, F.when(under > 0, under))
    return whole + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def insert(lang: np.ndarray, first: np.ndarray, source: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tree of sorted rows as (cell, row, depth, multiplicity) of its nodes, each named by the first cell that reaches it.

    Row r holds cells first[r] to first[r + 1]. It shares with the row before as many nodes as their cells agree from the left;
    the others are new. A node's multiplicity is that of all rows up to the next one that leaves its path.
    """
    long = np.diff(first)
    rows = np.repeat(np.arange(len(long)), long)
    depth = np.arange(len(source)) - first[rows]
    before = np.maximum(rows - 1, 0)
    other = first[before] + depth
    inside = (rows > 0) & (depth < long[before]) & (lang[rows] == lang[before])
    other = np.where(inside, other, 0)
    same = inside & (source == source[other]) & (count == count[other])
    shared = np.minimum.reduceat(np.where(same, len(source), depth), first[:-1])
    shared = np.minimum(shared, long)
    new = np.flatnonzero(depth >= shared[rows])
    passing = np.zeros(len(new), np.int64)
    for d in range(int(long.max(initial=0))):
        here = np.flatnonzero(depth[new] == d)
        leave = np.append(np.flatnonzero(shared <= d), len(long))
        r = rows[new[here]]
        passing[here] = leave[np.searchsorted(leave, r, "right")] - r
    return new, rows[new], depth[new], passing


def corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) of sorted (lang, items): what sources that share terms add to their divergence.

    ``items`` are (source, n, p, z) with p the share of n and z that of 0. Every Arrow batch of rows becomes a tree of its own; every node meets each of its
    ancestors once, whatever the number of terms that pass through both, and the sums of all trees add up.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            cells = lists.flatten()
            first = np.concatenate([np.zeros(1, np.int64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            lang, names = batch.column(0).dictionary_encode(), cells.field("source").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            tongue = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n, p, z = (cells.field(k).to_numpy(zero_copy_only=False) for k in ("n", "p", "z"))
            node, row, depth, copies = insert(tongue, first, code, n)
            kinds = len(names.dictionary)
            ends = np.cumsum(depth)
            i = 0
            while i < len(node):
                # about two million pairs of node and ancestor at a time
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 21), "right")))
                d = depth[i:j]
                start = np.concatenate([np.zeros(1, np.int64), np.cumsum(d)])
                y = np.repeat(node[i:j], d)
                x = np.arange(start[-1]) - np.repeat(start[:-1], d) + np.repeat(first[row[i:j]], d)
                value = (_gap(p[x], p[y]) - _gap(p[x], z[y]) - _gap(z[x], p[y]) + _gap(z[x], z[y])) * np.repeat(copies[i:j], d)
                key = (np.repeat(tongue[row[i:j]], d) * kinds + code[x]) * kinds + code[y]
                i = j
                if not len(key):
                    continue
                order = np.argsort(key, kind="stable")
                edge = np.flatnonzero(np.concatenate([np.ones(1, bool), np.diff(key[order]) != 0]))
                one = key[order][edge]
                take = lambda column, at: column.dictionary.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([take(lang, one // kinds // kinds), take(names, one // kinds % kinds), take(names, one % kinds), pa.array(np.add.reduceat(value[order], edge))], names=["lang", "a", "b", "value"])

    return rows.select("lang", "items").mapInArrow(local, "lang string, a string, b string, value long")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far every source of a language is from each other one, and its most typical terms.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those that ``least`` of its documents hold.
    A source gives a kept term of count c the share p = 1 + floor(10^9 (c + 2) / (N + 2V)), of N occurrences and V kept terms. Part
    ``pair`` has, for every other source of the language, the sum of floor((p - q)^2 / (p + q)) over all kept terms; part
    ``term`` the ``top`` terms whose share is above that in the whole language. All in integers.

    Most counts are zero. A sum over all terms starts from the one for no counts at all; counts of one source and zero of the other correct it, once per
    source and count; where both have the term, the nodes of the tree do (`corrections`). So no pair of sources meets term by term.

    Null texts, languages and sources count as ''. Empty texts have no terms; groups without terms are compared like others, with 0 where the language keeps
    no term. Rows that repeat count as often as they stand. Ranks are ordered by value downwards, then by item. A very long text is one slice of its own. Terms of a slice are told apart by 64 bits of a hash. Other columns are left out; an empty table gives no rows.
    """
    held = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    kept = stage(term_rows(held, least))
    cells = kept.select("lang", "term", F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + i["n"]).alias("all"), F.explode("items").alias("i")).select("lang", "term", "all", "i.source", "i.n")
    tongues = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + i["n"])).alias("whole"))
    groups = held.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("n").alias("own")), ["lang", "source"], "left").join(tongues, "lang", "left")
    groups = stage(groups.select("lang", "source", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("whole", F.lit(0)).alias("whole")))
    cells = cells.join(groups, ["lang", "source"])
    cells = stage(cells.select("lang", "source", "term", "n", share(F.col("n"), F.col("own"), F.col("v")).alias("p"), share(F.lit(0), F.col("own"), F.col("v")).alias("z"), share(F.col("all"), F.col("whole"), F.col("v")).alias("q")))

    paths = cells.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "n", "p", "z"))).alias("items"))
    # rows that begin alike lie together
    paths = paths.repartitionByRange("lang", F.slice("items", 1, 2)).sortWithinPartitions("lang", "items")
    ends = groups.select("lang", F.col("source").alias("other"), share(F.lit(0), F.col("own"), F.col("v")).alias("y"))
    none = groups.select("lang", "source", "v", share(F.lit(0), F.col("own"), F.col("v")).alias("z")).join(ends, "lang").filter("source < other")
    none = none.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.coalesce(F.col("v") * gap(F.col("z"), F.col("y")), F.lit(0)).alias("value"))
    lone = cells.groupBy("lang", "source", "p", "z").agg(F.count("*").alias("n")).join(ends, "lang").filter("source <> other")
    lone = lone.select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("n") * (gap(F.col("p"), F.col("y")) - gap(F.col("z"), F.col("y")))).alias("value"))
    total = none.unionByName(lone).unionByName(corrections(paths)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s")
    pair = total.select("lang", sides, "value").select("lang", "s.source", "s.item", "value")
    term = cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = [part.withColumn("rank", rank).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, part in (("pair", pair), ("term", term))]
    return out[0].unionByName(out[1].filter(F.col("rank") <= top))
