"""Clusters, near-duplicate vectors and source divergence against brute force, odd rows among them."""

import hashlib
import math
import random
import re

import numpy as np

from tidemark.llm import clusters, divergence, graph, near_dup
from tidemark.llm.common import stage

NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster string, n_links string, h int")


def whole(v, dims):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)


def test_clusters_against_plain_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6).astype(np.float32)], "x", "y", 1) for i in range(120)]
    rows += [rows[7], rows[7], (3, [0.5] * 6, None, None, None), (None, [0.25] * 6, "x", "y", 1), (200, None, "x", "y", 1), (201, [1.0] * 5, "x", "y", 1), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x", "y", 1), (203, [NAN] * 6, "x", "y", 1), (204, [INF] * 6, "x", "y", 1), (205, [], "x", "y", 1)]
    held = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if whole(v, 6)]
    order = sorted(held, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:8]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))
    for _ in range(3):
        by = {}
        for _, v in held:
            by.setdefault(near(v)[1], []).append(v)
        middle = [[sum(col) // len(by[n]) for col in zip(*by[n])] if n in by else c for n, c in enumerate(middle)]
    want = sorted((-1 if i is None else i, n, d) for i, v in held for d, n in [near(v)])
    got = clusters.clusters(table(spark, rows), k=8, rounds=3, dims=6).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got) == want
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
    assert all(r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster) and r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest() for r in got)


def test_clusters_few_and_none(spark):
    same = [(i, [1.0, 2.0], None, None, None) for i in range(3)]
    got = clusters.clusters(table(spark, same), k=40, dims=2).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in got] == [(0, 0, 0)] * 3
    assert clusters.clusters(table(spark, []), dims=2).count() == 0


def links(rows, least):
    """(links of every row, smallest id reachable) by comparing all rows."""
    def unit(v):
        return None if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v) else np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float))

    units = [unit(v) for _, v, *_ in rows]
    parent = list(range(len(rows)))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    n_links = [0] * len(rows)
    for a, u in enumerate(units):
        for b, v in enumerate(units):
            if a != b and u is not None and v is not None and len(u) == len(v) and u @ v >= least:
                n_links[a] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), r[0]), r[0])
    return sorted((-1 if r[0] is None else r[0], n_links[i], -1 if names.get(find(i)) is None else names[find(i)]) for i, r in enumerate(rows))


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    plain = lambda v: [float(x) for x in np.asarray(v, np.float32)]
    rows = [(i, plain(rng.normal(0, 1, 16)), "x", "y", 1) for i in range(500)]
    for g in range(30):  # groups of near copies, of two to thirty
        base = np.array(rows[g * 7][1])
        rows += [(1000 + g * 40 + j, plain(base * rng.uniform(0.5, 2) + rng.normal(0, 0.12, 16)), "x", "y", 1) for j in range(g + 1)]
    rows += [(2500 + i, rows[11][1], None, None, None) for i in range(60)]  # one vector again and again
    rows += [rows[20], (rows[21][0], plain(rng.normal(0, 1, 16)), "x", "y", 1), (None, rows[30][1], "x", "y", 1), (None, plain(rng.normal(0, 1, 16)), "x", "y", 1)]
    rows += [(3000, None, "x", "y", 1), (3001, [], "x", "y", 1), (3002, [0.0] * 16, "x", "y", 1), (3003, [-0.0] * 16, "x", "y", 1), (3004, [NAN] + [1.0] * 15, "x", "y", 1), (3005, [INF] + [1.0] * 15, "x", "y", 1), (3006, [None] + [1.0] * 15, "x", "y", 1)]
    rows += [(3010 + i, [1.0] * n, "x", "y", 1) for i, n in enumerate((3, 3, 4))] + [(3020, [3e38] * 16, "x", "y", 1), (3021, [1e-44] * 16, "x", "y", 1)]
    want = links(rows, 0.95)
    for few in (4096, 100):  # one shard, and many
        got = graph.near_vectors(table(spark, rows), rows=few).collect()
        told = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in got)
        found, true = sum(n for _, n, _ in told), sum(n for _, n, _ in want)
        assert len(told) == len(want) and all(a[0] == b[0] for a, b in zip(told, want))
        assert 0.97 * true <= found <= true
        assert sum(a != b for a, b in zip(told, want)) <= (0 if few > len(rows) else 0.02 * len(rows))
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert graph.near_vectors(table(spark, [])).count() == 0
    lone = graph.near_vectors(table(spark, [(5, None, None, None, None)])).first()
    assert (lone.vec_id, lone.n_links, lone.component_id, lone.kept) == (5, 0, 5, True)


def test_graph_expands_whole_ranges():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (700, 24))
    x[300:] = x[0] + rng.normal(0, 0.1, (400, 24))  # a dense group larger than any list
    x = graph.unit(x).astype(np.float32)
    starts = graph._medoids(x, np.zeros(700, int))
    built = graph.build(x, starts, 12, 16, 1.2)
    assert built.shape == (700, 12) and (built >= 0).any(axis=1).all() and not (built == np.arange(700)[:, None]).any()
    q, v = graph._pairs(x, built, np.arange(700), starts, 16, 0.9)
    true = (x @ x.T >= 0.9).sum()
    assert len(np.unique(q * 700 + v)) == len(q) and 0.99 * true <= len(q) <= true


def sources(docs, least, top):
    """The rows of the report, counted and summed term by term."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    clean = [(t or "", g or "", s or "") for t, g, s in docs]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(low)) for t, _, _ in clean]
    out = set()
    for lang in {g for _, g, _ in clean}:
        mine = [(s, w) for (_, g, s), w in zip(clean, words) if g == lang]
        kept = {w for w in {w for _, ws in mine for w in ws} if sum(w in ws for _, ws in mine) >= least}
        count = {s: {w: 0 for w in kept} for s, _ in mine}
        for s, ws in mine:
            for w in ws:
                if w in kept:
                    count[s][w] += 1
        all_ = {w: sum(c[w] for c in count.values()) for w in kept}
        share = lambda c, n: 1 + 10 ** 9 * (c + 2) // (n + 2 * len(kept))
        p = {s: {w: share(c[w], sum(c.values())) for w in kept} for s, c in count.items()}
        q = {w: share(all_[w], sum(all_.values())) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in count if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            terms = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w])[:top]
            out |= {(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(terms)}
    return out


def test_divergence_against_plain_sums(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdéßю") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    docs = []
    for i in range(260):
        lang, source = rng.choice(["en", "fr"]), f"s{min(rng.randrange(9), rng.randrange(9))}"
        some = vocabulary[:40] if lang == "en" else vocabulary[20:]
        docs.append((rng.choice([" ", "-", "1", "\n"]).join(rng.choice(some).upper() if rng.random() < 0.1 else rng.choice(some) for _ in range(rng.randrange(0, 40))), lang, source))
    docs += [docs[5]] * 12 + [(None, "en", "s1"), ("", "en", "empty"), ("words without a language", None, None), ("12 34", "de", "a"), ("once", "de", "b"), ("x" * 50_000 + " y", "de", None), ("É é ß", "en", "Źródło")]
    held = spark.createDataFrame([(*d, 1, "v", 2, 3) for d in docs], "text string, lang string, source string, rank int, value string, n int, h int")
    got = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.divergence(held, least=5, top=4).collect()}
    assert got == sources(docs, 5, 4)
    assert divergence.divergence(held.limit(0)).count() == 0


def test_tree_shares_paths():
    """Three rows of one language share nodes as far as they agree; the row of another language shares none."""
    lang = np.array([0, 0, 0, 1])
    rows = [[(0, 1), (1, 2)], [(0, 1), (1, 2), (2, 1)], [(0, 1), (2, 5)], [(0, 1), (2, 5)]]
    first = np.cumsum([0, *map(len, rows)])
    source, count = (np.array([c[k] for r in rows for c in r]) for k in (0, 1))
    cell, row, depth, copies = divergence.insert(lang, first, source, count)
    assert list(zip(row, depth, copies)) == [(0, 0, 3), (0, 1, 2), (1, 2, 1), (2, 1, 1), (3, 0, 1), (3, 1, 1)]
    assert list(cell) == [0, 1, 4, 6, 7, 8]


def test_links_are_found_in_rounds(spark):
    """Candidates of which some hold, in more rounds than one: the components are those of all links."""
    rng = random.Random(41)
    pairs = {(min(a, b), max(a, b)): rng.randrange(100) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(160)) if a != b}
    held = spark.createDataFrame([(a, b) for a, b in pairs if (a * 7 + b) % 3 == 0], "a long, b long")
    parent = {}

    def find(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for a, b in pairs:
        if (a * 7 + b) % 3 == 0:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    check = lambda asked, known, similarity: asked.join(known, ["a", "b"], "left_semi").select(*asked.columns)
    table = stage(spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a long, b long, s long"))
    for few, rounds in ((10_000, 4), (3, 2)):
        got = {r["node"]: r["component"] for r in near_dup.linked(table, held, 0.8, check, rounds, few).collect()}
        assert got == {n: find(n) for n in list(parent)}
