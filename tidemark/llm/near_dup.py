"""Near-duplicate documents by a chosen-path similarity join on their shingle sets.

Each document is a set of word shingles. In every one of several independent trees a node holds the
documents that agree on the minwise tokens chosen along its path. A node of few documents is
compared exhaustively; a larger one is branched again: its path picks one minwise
coordinate, sometimes a second, and documents with the same token there go on together. On
average a pair at the threshold keeps one common path per level, so every tree finds it
with a fair chance and the trees together nearly always. Copies by the thousand would be branched
for ever: at one level they are linked with what is closest to most of their node, and from then on a node
is done when all it holds is linked already, or when the few others have met the rest of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytes_text import U, column, distinct, mix, slices, word_hashes, word_shingles
from .common import components, discard, release, spots, stage, within

#: Minwise coordinates of a document, and the bits kept of each in its comparison sketch.
COORDINATES, BITS = 128, 2
_rng = np.random.default_rng(20240917)
_MULTIPLY = _rng.integers(1, 1 << 63, COORDINATES, dtype=U) | U(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=U)


def minwise(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) smallest 32-bit images of each non-empty set; rows of empty sets are zero."""
    out = np.zeros((len(bounds) - 1, COORDINATES), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[:-1][full]
        for c in range(COORDINATES):
            out[full, c] = np.minimum.reduceat(((values * _MULTIPLY[c] + _ADD[c]) >> U(32)).astype(np.uint32), starts)
    return out


def roots(n: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, node) of n texts at the roots of all trees."""
    return np.tile(np.arange(n), trees), mix(np.repeat(np.arange(1, trees + 1, dtype=U), n) * U(0x9E3779B97F4A7C15))


def branch(tokens: np.ndarray, row: np.ndarray, node: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """One level further down: (text number, node). A node's name holds its tree and whole path, and decides by which coordinates it is branched."""
    one = (mix(node + U(1)) % U(COORDINATES)).astype(np.int64)
    two = (one + 1 + (mix(node + U(2)) % U(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    twice = mix(node + U(3)) < U(int(second * 2.0 ** 64))
    row, parent, chosen = np.concatenate([row, row[twice]]), np.concatenate([node, node[twice]]), np.concatenate([one, two[twice]])
    return row, mix(parent * U(0xD6E8FEB86659FD93) + mix(tokens[row, chosen].astype(U) + (chosen.astype(U) << U(32))))


def sketch_words(tokens: np.ndarray) -> np.ndarray:
    """(texts, 4) 64-bit words: the lowest BITS of every coordinate."""
    bits = ((tokens[:, :, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    # the bits of a coordinate lie in the same place of different words
    planes = np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little")
    return np.ascontiguousarray(planes).reshape(len(tokens), -1).view(np.int64)


def _agree(a: Column, b: Column) -> Column:
    """Coordinates on which two sketches agree: their bits lie in words 0, 1 and again in 2, 3."""
    x = [a[f"w{i}"].bitwiseXOR(b[f"w{i}"]) for i in range(4)]
    return F.lit(COORDINATES) - F.bit_count(x[0].bitwiseOR(x[2])) - F.bit_count(x[1].bitwiseOR(x[3]))


def shingle_sets(docs: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, s1, s2 (signature of the whole set), w0-w3 (comparison sketch), tokens (minwise)."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = column(batch.column(1))
            for i, j, b, o in slices(buf, offsets):
                sets, bounds = distinct(*word_shingles(*word_hashes(b, o), words))
                tokens = minwise(sets, bounds)
                cols = {"doc_id": batch.column(0).slice(i, j - i), "n_shingles": pa.array(np.diff(bounds))}
                for name, x in (("s1", sets), ("s2", mix(sets))):
                    s = np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
                    cols[name] = pa.array((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64))
                words4 = sketch_words(tokens)
                cols |= {f"w{n}": pa.array(words4[:, n]) for n in range(4)}
                cols["tokens"] = pa.array([t.tobytes() for t in tokens], pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_shingles long, s1 long, s2 long, " + "".join(f"w{n} long, " for n in range(4)) + "tokens binary"
    return docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(local, schema)


def nodes(table: DataFrame, trees: int, second: float, wanted: DataFrame | None = None) -> DataFrame:
    """(rep, w0-w3, comp, node): every class once for each node it goes on to, from the nodes in its ``parents``, or from the roots where that is null.

    If nodes are ``wanted``, a bitmap of them drops nearly all others before anything is shuffled.
    """
    bitmap, number = spots(wanted, "node", hashed=True) if wanted is not None else (None, 0)
    # at most 128 MB
    bits = table.sparkSession.sparkContext.broadcast(bitmap) if number else None

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                tokens = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint32).reshape(-1, COORDINATES)
                above = part.column(7)
                if above.null_count:
                    row, node = roots(len(part), trees)
                else:
                    row, node = np.repeat(np.arange(len(part)), above.value_lengths().to_numpy()), above.flatten().to_numpy().view(U)
                row, node = branch(tokens, row, node, second)
                if bits is not None:
                    spot = (node & U(number - 1)).astype(np.int64)
                    of = (bits.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
                    row, node = row[of], node[of]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[part.column(n).take(at) for n in range(6)], pa.array(node.view(np.int64))], names=["rep", "w0", "w1", "w2", "w3", "comp", "node"])

    return table.select("rep", "w0", "w1", "w2", "w3", "comp", "tokens", "parents").mapInArrow(local, "rep long, w0 long, w1 long, w2 long, w3 long, comp long, node long")


def candidates(table: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, trees: int, lead: int, second: float, small: int, leaders: int, least: int, at_once: int, levels: int = 48) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, s) of classes that meet in a node and may be linked, s growing with their likeness, and the components of links found already, if any. The staged ``table`` is used up.

    Small nodes are compared by sketches that agree in ``least`` coordinates. From level ``lead`` on (see `_attached`) a large node is done if all
    of it is linked already; if its others times its size are at most ``at_once``, they meet all of it by `parities`; if not, or at an earlier level, it is branched.
    """
    found, known, sketch, marks = [], None, F.struct("rep", "w0", "w1", "w2", "w3", "comp").alias("d"), None
    staged, table = table, table.withColumn("comp", F.col("rep")).withColumn("parents", F.lit(None).cast("array<long>"))
    for level in range(levels):
        rows = nodes(table, trees, second)
        sizes = rows.groupBy("node", "comp").agg(F.count("*").alias("c")).groupBy("node").agg(F.sum("c").alias("n"), F.max("c").alias("c")) if marks is not None else rows.groupBy("node").agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("c"))
        sizes = stage(sizes.filter("n > c"))
        # large nodes are left behind before anything is gathered by node
        fits = sizes.filter(F.col("n") <= small).select("node")
        # the first two levels hold most rows; later a bitmap costs more than it saves
        few = (nodes(table, trees, second, fits) if level < 2 else rows).join(fits, "node", "left_semi").repartition("node")
        few = few.groupBy("node").agg(F.collect_list(sketch).alias("ds"))
        near = F.transform("ds", lambda x: F.transform(F.filter("ds", lambda y: (y["rep"] > x["rep"]) & (y["comp"] != x["comp"]) & (_agree(x, y) >= least)), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b"), _agree(x, y).cast("long").alias("s"))))
        found.append(stage(few.select(F.explode(F.flatten(near)).alias("p")).select("p.a", "p.b", "p.s").distinct()))
        release(table.sparkSession)
        large = sizes.filter(F.col("n") > small)
        if level >= lead and not large.isEmpty():
            if marks is None:
                crowd = stage(rows.join(large.select("node"), "node", "left_semi").select("node", sketch))
                held = sets_of(crowd.select(F.col("d.rep").alias("doc_id")).distinct())
                known = _attached(crowd, held, similarity, leaders, least)
                marks = parities(held)
                discard(crowd, held)
                table = table.drop("comp").join(known.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
                rows = nodes(table, trees, second)
                sizes = rows.join(large.select("node"), "node", "left_semi").groupBy("node", "comp").agg(F.count("*").alias("c")).groupBy("node").agg(F.sum("c").alias("n"), F.max("c").alias("c"))
                large = stage(sizes.filter("n > c"))
            direct = ((F.col("n") - F.col("c")) * F.col("n") <= at_once) | F.lit(level + 1 == levels)
            found.append(_blocks(rows.select("rep", "comp", "node").join(large.filter(direct).select("node"), "node", "left_semi"), marks, similarity))
            large = large.filter(~direct)
        # only the large nodes of a class are branched; it is in a bounded number of nodes of a level
        going = rows.select("rep", "node").join(large.select("node"), "node", "left_semi").groupBy("rep").agg(F.collect_list("node").alias("parents"))
        before, staged = staged, stage(table.drop("parents").join(going, "rep"))
        table = staged
        discard(before)
        release(table.sparkSession)
        if table.isEmpty():
            break
    discard(staged)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct(), known


def _attached(crowd: DataFrame, held: DataFrame, similarity: float, leaders: int, least: int) -> DataFrame:
    """(node, component) over the links of texts in large nodes with the text, among those closest to what most of a node has, that is closest to them.

    Copies of one text differ from it in different places, so the majority bit of every
    coordinate is that of the text they come from.
    """
    bits = [F.sum(F.shiftrightunsigned(F.col(f"d.w{w}"), i).bitwiseAND(F.lit(1))).alias(f"b{w}_{i}") for w in range(4) for i in range(64)]
    ones = crowd.groupBy("node").agg(F.count("*").alias("n"), *bits)
    most = ones.select("node", F.struct(*[F.expr(" | ".join(f"shiftleft(cast(b{w}_{i} * 2 >= n as bigint), {i})" for i in range(64))).alias(f"w{w}") for w in range(4)]).alias("m"))
    near = crowd.join(most, "node").select("node", "d", _agree(F.col("d"), F.col("m")).alias("s"))
    # the best of every part first: no group is sorted whole
    for part in (F.pmod(F.xxhash64("d.rep"), F.lit(256)), F.lit(0)):
        near = near.withColumn("_p", part).repartition("node", "_p")
        w = Window.partitionBy("node", "_p").orderBy(F.col("s").desc(), "d.rep")
        near = near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= leaders).drop("_r")
    heads = near.groupBy("node").agg(F.collect_list("d").alias("hs"))
    best = F.array_max(F.transform("hs", lambda h: F.struct(F.when(h["rep"] != F.col("d.rep"), _agree(F.col("d"), h)).otherwise(-1).alias("s"), h["rep"].alias("h"))))
    met = crowd.join(heads, "node").select(F.col("d.rep").alias("rep"), best.alias("p")).groupBy("rep").agg(F.max("p").alias("p")).filter(F.col("p.s") >= least)
    pairs = stage(met.select(F.least("rep", "p.h").alias("a"), F.greatest("rep", "p.h").alias("b"), F.col("p.s").cast("long").alias("s")).distinct())
    return components(verified(pairs, held, similarity))


def parities(held: DataFrame) -> DataFrame:
    """(rep, n, marks): the size of every set, and 2048 bits of which each element turns one over."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), U) for x in batch.column(1)]
            marks = [np.packbits(np.bincount((x & U(2047)).astype(np.int64), minlength=2048) & 1) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([m.astype(np.uint8).tobytes() for m in marks], pa.binary())], names=["rep", "n", "marks"])

    return stage(held.select("doc_id", "held").mapInArrow(local, "rep long, n long, marks binary"))


def _blocks(rows: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, s) of nodes in which everything that is not of the largest component meets all the rest.

    Two sets differ in at least as many elements as bits of their marks; at the threshold t in at most (1 - t) / (1 + t) of
    their sizes' sum. So no link is turned down.
    """
    percent = round(similarity * 100)

    def local(part: pa.Table) -> pa.Table:
        part = part.sort_by("rep")
        rep, comp, n = (part[k].to_numpy() for k in ("rep", "comp", "n"))
        bits = np.frombuffer(b"".join(part["marks"].to_pylist()), U).reshape(len(rep), -1)
        names, counts = np.unique(comp, return_counts=True)
        few = np.flatnonzero(comp != names[np.argmax(counts)])
        out = [[np.zeros(0, np.int64)] * 3]
        for i in range(0, len(few), max(1, (1 << 22) // bits.size + 1)):
            x = few[i:i + max(1, (1 << 22) // bits.size + 1)]
            apart = np.bitwise_count(bits[x][:, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
            total = n[x][:, None] + n
            u, v = np.nonzero((apart * (100 + percent) <= total * (100 - percent)) & (comp[x][:, None] != comp))
            alike = np.maximum(total[u, v] - apart[u, v], 0) / (total[u, v] + apart[u, v])
            out.append([np.minimum(rep[x[u]], rep[v]), np.maximum(rep[x[u]], rep[v]), (COORDINATES * (alike + (1 - alike) / 2 ** BITS)).astype(np.int64)])
        return pa.table(dict(zip("abs", (np.concatenate(c) for c in zip(*out)))))

    return stage(rows.join(marks, "rep").groupBy("node").applyInArrow(local, "a long, b long, s long").distinct())


def whole_sets(docs: DataFrame, ids: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """(doc_id, held): the hashes of the whole set of every text named in ``ids``, and of a few others.

    A bitmap of the ids decides within the scan which texts are read, so no text is shuffled.
    """
    bitmap, number = spots(ids, "doc_id")
    # at most 128 MB
    bits = docs.sparkSession.sparkContext.broadcast(bitmap)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)))
            buf, offsets = column(batch.column(1))
            for i, j, b, o in slices(buf, offsets):
                sets, bounds = distinct(*word_shingles(*word_hashes(b, o), words))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i), "held": pa.array([sets[a:z].tobytes() for a, z in zip(bounds[:-1], bounds[1:])], pa.binary())})

    texts = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    sets = texts.withColumn("spot", F.pmod(F.xxhash64("doc_id"), F.lit(number))).mapInArrow(local, "doc_id long, held binary")
    # of a repeated id the smallest set, as above
    sets = sets.groupBy("doc_id").agg(F.min(F.struct(F.octet_length("held").alias("n"), "held")).alias("m"))
    return stage(sets.select("doc_id", "m.held"))


def verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b, further numbers) whose whole shingle sets reach ``similarity``."""
    percent = round(similarity * 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                common = int((np.searchsorted(x, y, "right") - np.searchsorted(x, y, "left")).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(range(2, batch.num_columns)).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("held").alias("__x")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("held").alias("__y")), "b")
    return sides.select("__x", "__y", *pairs.columns).mapInArrow(compare, ", ".join(f"{c} long" for c in pairs.columns))


def linked(pairs: DataFrame, held: DataFrame, similarity: float, verified: Callable[..., DataFrame] = verified, rounds: int = 4, few: int = 20_000, known: DataFrame | None = None) -> DataFrame:
    """(node, component) over the verified pairs, and over links ``known`` before as (node, component).

    First every text is verified against its closest candidate, then against its closest one in another component, ``rounds`` times or until ``few`` such pairs
    are left; then all that are left. Components are joined by what is found. Pairs within a component cannot change it, so none is missed, and no later round reads them.
    """
    asked = None
    for n in range(rounds + 1):
        sides = pairs
        if known is not None:
            sides = pairs.join(known.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            sides = sides.select("a", "b", "s", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).filter("ca <> cb")
            if asked is not None:
                sides = sides.join(asked.select("a", "b"), ["a", "b"], "left_anti")
        else:
            sides = pairs.select("a", "b", "s", F.col("a").alias("ca"), F.col("b").alias("cb"))
        sides = stage(sides)
        left = sides.count()
        if not left and known is not None:
            break
        if n < rounds and left > few:
            ends = sides.select(F.col("a").alias("u"), "a", "b", "ca", "cb", "s").unionByName(sides.select(F.col("b").alias("u"), "a", "b", "ca", "cb", "s"))
            asked = stage(ends.groupBy("u").agg(F.max(F.struct("s", "a", "b", "ca", "cb")).alias("p")).select("p.a", "p.b", "p.ca", "p.cb").distinct())
        else:
            asked = sides.select("a", "b", "ca", "cb")
        # only what is asked for travels: held is many times larger in later rounds
        needed = within(held, held.columns[0], asked.select(F.explode(F.array("a", "b")).alias("id")), 2 * left)
        more = stage(verified(asked, needed, similarity))
        if known is None:
            known = stage(components(more))
        elif not more.isEmpty():
            merged = components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("c"), F.col("component").alias("m"))
            every = known.select("node", F.col("component").alias("c")).unionByName(more.select(F.col("a").alias("node"), F.col("ca").alias("c"))).unionByName(more.select(F.col("b").alias("node"), F.col("cb").alias("c"))).distinct()
            known = stage(every.join(merged, "c", "left").select("node", F.coalesce("m", "c").alias("component")))
        release(held.sparkSession)
        if left <= few or n == rounds:
            break
        pairs = sides.select("a", "b", "s")
    return known


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8,
                    trees: int = 12, lead: int = 4, second: float = 0.25, small: int = 48, leaders: int = 3, at_once: int = 1 << 16) -> DataFrame:
    """One row per document with an id: doc_id, n_shingles, component_id, kept.

    Documents are linked where the Jaccard likeness of their sets of ``words``-word
    shingles (lower-cased) is at least ``similarity``; a text of fewer words is one shingle.
    ``component_id`` is the smallest doc_id reachable over links, ``kept`` marks that document.
    Texts without words, null ones too, are linked with nothing.

    Documents with the same set become one class first, so exact copies are never paired.
    Classes go through ``trees`` trees; nodes of up to ``small`` classes are compared pair by pair, larger ones are branched. At level ``lead``
    what is in large nodes is linked, as far as it reaches the likeness, with the closest of ``leaders`` texts that have what most of a node has. After that,
    nodes are branched until the classes outside their largest component, times all, are ``at_once`` or fewer, and then compared whole.
    Sketches of 256 bits sort out most pairs, with a margin of four standard deviations; what is left is confirmed on the whole sets, as 64-bit hashes.

    A repeated doc_id counts once, with the smallest of its sets; rows with a null id are
    left out. Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = shingle_sets(docs, doc, text, words).filter("doc_id IS NOT NULL")
    table = stage(rows)
    repeated = table.groupBy("doc_id").agg(F.min(F.struct("n_shingles", "s1", "s2")).alias("s"))
    members = table.select("doc_id", "n_shingles", "s1", "s2").join(repeated.select(F.col("doc_id"), "s"), "doc_id").filter("s.n_shingles = n_shingles and s.s1 = s1 and s.s2 = s2").drop("s").distinct()
    classes = members.filter("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    heads = stage(members.join(classes, ["n_shingles", "s1", "s2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")))
    one = table.join(heads.filter("rep = doc_id and n_shingles > 0").select("doc_id", "rep", F.col("n_shingles").alias("_n")), "doc_id").filter("_n = n_shingles").dropDuplicates(["doc_id"])
    # agreement of a pair at the threshold less four standard deviations
    chance = similarity + (1 - similarity) / 2 ** BITS
    least = int(COORDINATES * chance - 4 * (COORDINATES * chance * (1 - chance)) ** 0.5)
    trees_of = stage(one.select("rep", "w0", "w1", "w2", "w3", "tokens"))
    discard(table)
    release(spark)
    found, known = candidates(trees_of, lambda ids: whole_sets(docs, ids, doc, text, words), similarity, trees, lead, second, small, leaders, least, at_once)
    pairs = stage(found)
    release(spark)
    held = whole_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), doc, text, words)
    release(spark)
    known = linked(pairs, held, similarity, known=known)
    discard(held, pairs)
    out = heads.join(known, heads["rep"] == known["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("component_id") == F.col("doc_id"))
