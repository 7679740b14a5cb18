"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, stage

#: Vectors that centroids are fitted on, the most centroids of one length, and the vectors that recall is audited with.
SAMPLE, MOST_SHARDS, AUDITED = 32_768, 4096, 512


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by their largest component first so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` unit centroids of unit vectors, started at the first rows."""
    c = x[:k].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def prune(x: np.ndarray, points: np.ndarray, found: np.ndarray, width: int, alpha: float) -> np.ndarray:
    """(points, width) neighbours out of candidates ``found``, -1 where there are fewer.

    Closest first; a chosen one strikes out every candidate that is ``alpha`` times closer to it than to the point. What is left
    leads in different directions.
    """
    here = np.where((found >= 0) & (found != points[:, None]), np.einsum("bd,bcd->bc", x[points], x[found]), -np.inf)
    order = np.argsort(-here, axis=1, kind="stable")
    found, here = np.take_along_axis(found, order, 1), np.take_along_axis(here, order, 1)
    y = x[found]
    between = alpha * alpha * (2 - 2 * (y @ y.transpose(0, 2, 1)))
    alive, to_point = here > -np.inf, 2 - 2 * here
    out, used = np.full((len(points), width), -1, np.int64), np.zeros(len(points), np.int64)
    for j in range(found.shape[1]):
        take = np.flatnonzero(alive[:, j] & (used < width))
        if len(take):
            out[take, used[take]] = found[take, j]
            used[take] += 1
            alive[take] &= between[take, j] > to_point[take]
    return out


def greedy(x: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int, least: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, seen, keys) after best-first walks of all queries at once from ``starts``: the ``beam`` best of each, what it has met, and query * len(x) + node of all that is within ``least``."""
    rows = np.arange(len(queries))
    seen = np.zeros((len(queries), len(x)), bool)
    seen[:, starts] = True
    at = np.tile(starts, (len(queries), 1))
    near = queries @ x[starts].T
    q, n = np.nonzero(near >= least)
    keys = [q * len(x) + starts[n]]
    if len(starts) < beam:
        at = np.pad(at, ((0, 0), (0, beam - len(starts))), constant_values=-1)
        near = np.pad(near, ((0, 0), (0, beam - len(starts))), constant_values=-np.inf)
    top = np.argsort(-near, axis=1, kind="stable")[:, :beam]
    at, near, open_ = np.take_along_axis(at, top, 1), np.take_along_axis(near, top, 1), np.take_along_axis(near, top, 1) > -np.inf
    going = rows
    while len(going):
        score = np.where(open_[going], near[going], -np.inf)
        best = np.argmax(score, axis=1)
        live = score[np.arange(len(going)), best] > -np.inf
        going, best = going[live], best[live]
        if not len(going):
            break
        open_[going, best] = False
        more = links[at[going, best]]
        fresh = (more >= 0) & ~seen[going[:, None], more]
        seen[np.broadcast_to(going[:, None], more.shape)[fresh], more[fresh]] = True
        gained = np.where(fresh, np.einsum("bd,bcd->bc", queries[going], x[more]), -np.inf)
        q, n = np.nonzero(gained >= least)
        keys.append(going[q] * len(x) + more[q, n])
        every, worth = np.concatenate([at[going], np.where(fresh, more, -1)], 1), np.concatenate([near[going], gained], 1)
        stay = np.argsort(-worth, axis=1, kind="stable")[:, :beam]
        at[going], near[going] = np.take_along_axis(every, stay, 1), np.take_along_axis(worth, stay, 1)
        open_[going] = np.take_along_axis(np.concatenate([open_[going], fresh], 1), stay, 1)
    return at, seen, np.concatenate(keys)


def build(x: np.ndarray, starts: np.ndarray, width: int, beam: int, alpha: float, block: int = 512) -> np.ndarray:
    """(vectors, width) adjacency of a robust-pruned graph, -1 where a list is not full.

    Vectors are inserted in blocks that double in size: each walks the graph so far from ``starts``, its neighbours are pruned from what it met and from the closest of
    its block, and every new neighbour gets a link back, pruned again where its list is full.
    """
    order = np.concatenate([starts, np.setdiff1d(np.arange(len(x)), starts)])
    links = np.full((len(x), width), -1, np.int64)
    done = 0
    while done < len(x):
        size = min(max(64, len(starts), done), block if done else max(256, len(starts)), len(x) - done)
        new = order[done:done + size]
        among = x[new] @ x[new].T
        np.fill_diagonal(among, -np.inf)
        few = min(size - 1, beam if not done else 12)
        found = new[np.argpartition(-among, few - 1, axis=1)[:, :few]] if few > 0 else np.full((size, 1), -1, np.int64)
        if done:
            found = np.concatenate([greedy(x, links, x[new], starts, beam)[0], found], 1)
        links[new] = prune(x, new, found, width, alpha)
        done += size
        here, back = np.repeat(new, width), links[new].ravel()
        here, back = here[back >= 0], back[back >= 0]
        known = (links[back] == here[:, None]).any(axis=1)
        here, back = here[~known], back[~known]
        by = np.lexsort((-np.einsum("ij,ij->i", x[here], x[back]), back))
        here, back = here[by], back[by]
        head = np.searchsorted(back, back, "left")
        place = (links[back] >= 0).sum(axis=1) + np.arange(len(back)) - head
        fits = place < width
        full = np.unique(back[~fits])
        whole = np.isin(back, full)
        links[back[~whole], place[~whole]] = here[~whole]
        for i in range(0, len(full), block):
            some = full[i:i + block]
            wide = np.full((len(some), 3 * width), -1, np.int64)
            wide[:, :width] = links[some]
            at = np.searchsorted(some, back)
            mine = whole & (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == back)
            slot = width + (np.arange(len(back)) - head)[mine]
            ok = slot < 3 * width
            wide[at[mine][ok], slot[ok]] = here[mine][ok]
            links[some] = prune(x, some, wide, width, alpha)
    return links


def _pairs(x: np.ndarray, links: np.ndarray, points: np.ndarray, starts: np.ndarray, beam: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query number, node) of all nodes met within ``least``: a greedy walk first, then every node in range is expanded until none is new.

    Ranges are expanded along links in both directions: a node at the rim of a dense group is in no other's list, but has one of its own.
    """
    _, seen, met = greedy(x, links, x[points], starts, beam, least)
    seen[np.arange(len(points)), points] = True
    # a query is a node itself
    out = np.unique(np.concatenate([np.arange(len(points)) * len(x) + points, met]))
    back, to = np.nonzero(links >= 0)
    to = links[back, to]
    to, back = np.concatenate([to, back]), np.concatenate([back, to])
    order = np.argsort(to, kind="stable")
    back, ends = back[order], np.searchsorted(to[order], np.arange(len(x) + 1))
    q, v = out // len(x), out % len(x)
    held = [out]
    while len(q):
        grown = []
        for i in range(0, len(q), 8192):
            some = v[i:i + 8192]
            n = ends[some + 1] - ends[some]
            more = back[np.arange(n.sum()) + np.repeat(ends[some] - np.cumsum(n) + n, n)]
            who = np.repeat(q[i:i + 8192], n)
            fresh = ~seen[who, more]
            key = np.unique(who[fresh] * len(x) + more[fresh])
            a, b = key // len(x), key % len(x)
            seen[a, b] = True
            grown.append(key[np.einsum("ij,ij->i", x[points[a]], x[b]) >= least])
        key = np.concatenate(grown)
        held.append(key)
        q, v = key // len(x), key % len(x)
    key = np.concatenate(held)
    return key // len(x), key % len(x)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a with b; every label is the smallest number of its component."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            deeper = label[label]
            if (deeper == label).all():
                break
            label = deeper


def _matrix(blobs: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).astype(np.float64).reshape(len(blobs), -1)


def _medoids(x: np.ndarray, home: np.ndarray) -> np.ndarray:
    """The vector closest to the middle, of all and of those of every home that the shard holds."""
    out = [int(np.argmax(x @ x.mean(axis=0)))]
    for h in np.unique(home):
        some = np.flatnonzero(home == h)
        out.append(int(some[np.argmax(x[some] @ x[some].mean(axis=0))]))
    return np.unique(out)


def _assigned(classes: DataFrame, middles: dict[int, np.ndarray], overlap: int, kind: str) -> DataFrame:
    """(dims, shard, home, h, c, blob): every vector in the ``overlap`` closest shards of its length; ``home`` is the closest."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for n in np.unique(dims):
                part = batch.filter(pa.array(dims == n))
                middle = middles.get(int(n))
                if middle is None:
                    near = np.zeros((len(part), 1), np.int64)
                else:
                    near = np.argsort(-(unit(_matrix(part.column(3), kind)) @ middle.T), axis=1, kind="stable")[:, :overlap]
                each = pa.array(np.repeat(np.arange(len(part)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(each), pa.array(near.ravel().astype(np.int32)), pa.array(np.repeat(near[:, 0], near.shape[1]).astype(np.int32)), *[part.column(i).take(each) for i in (1, 2, 3)]], names=["dims", "shard", "home", "h", "c", "blob"])

    return classes.select("dims", "h", "c", "blob").mapInArrow(local, "dims int, shard int, home int, h long, c long, blob binary")


def _built(shards: DataFrame, width: int, beam: int, alpha: float, kind: str) -> DataFrame:
    """(h, next): the adjacency lists of every shard's graph."""
    def local(part: pa.Table) -> pa.Table:
        part = part.sort_by("h")
        x = unit(_matrix(part["blob"], kind)).astype(np.float32)
        links = build(x, _medoids(x, part["home"].to_numpy()), width, beam, alpha)
        h = part["h"].to_numpy()
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum((links >= 0).sum(axis=1))])
        return pa.table({"h": part["h"], "next": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[links[links >= 0]]))})

    return shards.groupBy("dims", "shard").applyInArrow(local, "h long, next array<long>")


def _searched(shards: DataFrame, similarity: float, beam: int, kind: str, slack: float = 0.03) -> DataFrame:
    """(h, links, root): links (vectors) of every class searched in its home shard, and one tie per class that is linked within a shard."""
    def local(part: pa.Table) -> pa.Table:
        part = part.sort_by("h")
        raw = _matrix(part["blob"], kind)
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        size = np.sqrt((raw * raw).sum(axis=1))
        x = (raw / size[:, None]).astype(np.float32)
        h, c, home = (part[k].to_numpy() for k in ("h", "c", "home"))
        lists = part["next"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        long = lists.value_lengths().to_numpy(zero_copy_only=False)
        node = np.searchsorted(h, lists.flatten().to_numpy())
        here = (node < len(h)) & (h[np.minimum(node, len(h) - 1)] == lists.flatten().to_numpy())
        row, slot = np.repeat(np.arange(len(h)), long), np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        links = np.full((len(h), max(1, int(long.max(initial=0)))), -1, np.int64)
        links[row[here], slot[here]] = node[here]
        starts = _medoids(x, home)
        mine = np.flatnonzero(home == part["shard"][0].as_py())
        number, label = np.zeros(len(h), np.int64), np.arange(len(h))
        block = max(1, min(512, (1 << 25) // len(h)))
        for i in range(0, len(mine), block):
            points = mine[i:i + block]
            q, v = _pairs(x, links, points, starts, beam, similarity - slack)
            q = points[q]
            q, v = q[q != v], v[q != v]
            sure = np.concatenate([np.einsum("ij,ij->i", raw[q[j:j + 65536]], raw[v[j:j + 65536]]) / (size[q[j:j + 65536]] * size[v[j:j + 65536]]) for j in range(0, len(q), 65536)] or [np.zeros(0)]) >= similarity
            np.add.at(number, q[sure], c[v[sure]])
            label = _union(label, q[sure], v[sure])
        tied = np.flatnonzero(label != np.arange(len(h)))
        return pa.table({"h": np.concatenate([h[mine], h[tied]]), "links": pa.array(np.concatenate([number[mine], np.zeros(len(tied), np.int64)]), mask=np.arange(len(mine) + len(tied)) >= len(mine)), "root": pa.array(np.concatenate([h[mine], h[label[tied]]]))})

    return shards.groupBy("dims", "shard").applyInArrow(local, "h long, links long, root long")


def audit(classes: DataFrame, links: DataFrame, similarity: float, kind: str, asked: int = AUDITED) -> float:
    """Share of the true links that ``links`` (h, links) has, for ``asked`` classes chosen by hash, each compared with every class."""
    sample = classes.orderBy(F.xxhash64("h", F.lit(1)), "h").limit(asked).select("dims", "h", "blob").toArrow()
    lengths, names = sample["dims"].to_numpy(), sample["h"].to_numpy()
    wanted = {int(n): (names[lengths == n], unit(_matrix(sample.filter(pa.array(lengths == n))["blob"], kind))) for n in np.unique(lengths)}

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for n, (ids, q) in wanted.items():
                part = batch.filter(pa.array(dims == n))
                if len(part):
                    near = unit(_matrix(part.column(3), kind)) @ q.T >= similarity
                    near &= part.column(1).to_numpy()[:, None] != ids
                    true = part.column(2).to_numpy() @ near.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[true > 0]), pa.array(true[true > 0])], names=["h", "n"])

    true = classes.select("dims", "h", "c", "blob").mapInArrow(local, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    got = true.join(links, "h", "left").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("links", F.lit(0)))).alias("f")).first()
    return got["f"] / got["n"] if got["n"] else 1.0


def near_vectors(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", similarity: float = 0.95, overlap: int = 4, width: int = 24, beam: int = 32, alpha: float = 1.2, rows: int = 4096, recall: float = 0.97) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: how many others have a cosine of at least ``similarity``, and the smallest id reachable.

    Equal vectors become one class first. Centroids fitted on at most `SAMPLE` classes make shards of about ``rows`` (more on large tables, see below); every class goes to its ``overlap``
    closest ones. Each shard builds a graph of ``width`` links a node, pruned with ``alpha``; the lists of a node from all its shards are united. Then every class is
    looked for in its closest shard: a best-first walk with ``beam`` places from the medoids, and from what is in range the whole range is expanded. Cosines are
    confirmed in double precision, so no link is wrong; links between shards join components by union-find. Pairs never leave a task.

    The index may miss links. `AUDITED` classes are compared with the whole table; while they have less than ``recall`` of their links, overlap and beam are doubled,
    until every shard holds everything. If that is not enough either, a warning tells the figure.

    A shard holds about max(rows, sqrt(classes * overlap), classes * overlap / MOST_SHARDS) vectors in memory: 1 M at 10^9 classes.

    Rows that are null, empty, zero, or hold null or non-finite components have no links and are their own component. Vectors of different lengths are not linked. Rows that
    repeat an id are vectors of their own; a row without an id counts, but gives no component its name. Classes are told apart by 64 bits of a hash.
    Other columns are left out. An empty table gives no rows.
    """
    element = vectors.schema[vector].dataType.elementType
    kind, name = ("<f4", "float") if isinstance(element, T.FloatType) else ("<f8", "double")
    v = F.col(vector).cast(f"array<{name}>")
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # zero has one sign
    held = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.when(sound, F.transform(v, lambda x: x + F.lit(0).cast(name))).alias("v")).withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v")))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, ends = lists.flatten().to_numpy().astype(kind), np.concatenate([np.zeros(1, np.int64), np.cumsum(lists.value_lengths().to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int32)), pa.array([flat[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:])], pa.binary())], names=["h", "c", "least", "dims", "blob"])

    grouped = held.filter("h IS NOT NULL").groupBy("h", "v").agg(F.count("*").alias("c"), F.min("vec_id").alias("least"))
    classes = stage(grouped.select("h", "c", "least", "v").mapInArrow(bytes_of, "h long, c long, least long, dims int, blob binary"))
    sizes = {r["dims"]: r["count"] for r in classes.groupBy("dims").count().collect()}
    if not sizes:
        return held.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.orderBy(F.xxhash64("h"), "h").limit(SAMPLE).select("dims", "blob").toArrow()
    lengths = sample["dims"].to_numpy()
    middles = {}
    for n, count in sizes.items():
        some = sample.filter(pa.array(lengths == n))
        k = min(-(-count * overlap // max(rows, int((count * overlap) ** 0.5))), MOST_SHARDS, -(-len(some) // 8)) if count > rows else 1
        if k > 1:
            middles[n] = centroids(unit(_matrix(some["blob"], kind)), k)
    while True:
        shards = _assigned(classes, middles, overlap, kind)
        union = stage(_built(shards, width, beam, alpha, kind).groupBy("h").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next")))
        found = stage(_searched(shards.join(union, "h"), similarity, beam, kind))
        links = found.filter("links IS NOT NULL").select("h", "links")
        share = audit(classes, links, similarity, kind)
        if share >= recall:
            break
        if overlap >= max([len(m) for m in middles.values()], default=1):
            warnings.warn(f"the audit found {share:.3f} of the links, less than {recall}", stacklevel=2)
            break
        overlap, beam = overlap * 2, beam * 2
    joined = components(found.filter("links IS NULL").select(F.col("h").alias("a"), F.col("root").alias("b")))
    joined = joined.select(F.col("node").alias("h"), "component").join(classes.select("h", "least"), "h")
    named = joined.select("h", "component").join(joined.groupBy("component").agg(F.min("least").alias("first")), "component").select("h", "first")
    table = classes.join(links, "h", "left").join(named, "h", "left").select("h", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n"), F.coalesce("first", "least").alias("first"))
    out = held.select("vec_id", "h").join(table, "h", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("first", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
