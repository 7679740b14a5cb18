"""Operators of the corpus subpackage against brute force, round trips and planted cases."""

import os
import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, lines, lm, mips, mixing, near_dup, packing, quality, sharding, warc
from tidemark.llm.common import components, stage, within

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "A b", "x  y\n\n z ", "ß é ü", "one\ntwo\none", "<|endoftext|> in text", "don't  's 12 a\n b \n"]


def prose(rng, words, size=400):
    names = ["".join(rng.choice(string.ascii_lowercase) for _ in range(2 + n % 7)) for n in range(size)]
    return " ".join(rng.choice(names) for _ in range(words))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeated rows, a null id, a very long text, and columns whose names the operators use themselves."""
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "text without id"), (3, "a"), (20, prose(rng, 60_000)), (21, "lone " * 3), (21, "lone " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"block": F.lit("b"), "row": F.lit(1), "h": F.lit("h"), "rate": F.lit(0.5), "score": F.lit("s"), "node": F.lit(2), "range": F.lit(1), "line": F.lit("l"), "lang": F.lit("en")})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


# packing

def test_encoder_equals_tokenizer():
    coder, rng = packing.Encoder(VOCABULARY, remembered=50), random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab \n'.é1 ") for _ in range(60)) for _ in range(200)]
    got = [np.frombuffer(i, "<u4").tolist() for i in coder.encode(texts)]
    assert got == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_returns_every_id_once(spark, odd):
    coder = packing.Encoder(VOCABULARY)
    pieces = packing.pack(odd.filter("doc_id <> 3 and doc_id <> 21").repartition(3), VOCABULARY, length=64, windows=3, least=4, fan_in=2).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for i, ps in by_doc.items():
        ids = b"".join(bytes(p["ids"]) for p in sorted(ps, key=lambda p: p["start"]))
        assert np.frombuffer(ids, "<u4").tolist() == coder.tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1]
    sizes = []
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes.append(at)
    assert all(64 - 3 <= s <= 64 or s & (s - 1) == 0 for s in sizes)


def test_packer_places_best_fit_and_emits_the_fullest():
    p = packing.Packer(10, 2, 99)
    ids = lambda n: bytes(4 * n)
    assert not list(p.add(1, ids(6))) and not list(p.add(2, ids(7)))
    assert not list(p.add(3, ids(3))) == []  # closes the window of document 2
    assert not list(p.add(4, ids(5)))
    (full,) = p.add(5, ids(8))  # no window holds it: the fullest goes
    assert [q[0] for q in full] == [1]


def test_pack_empty(spark):
    assert packing.pack(empty(spark), VOCABULARY).count() == 0


# language model

def test_probabilities_sum_to_one(spark):
    texts = ["a b a c", "b a", "c c a b"]
    followers = {"c": 1, "b": 2, None: 1}  # what training has after a; None: the end
    counts, n, v = {"a": 4, "b": 3, "c": 3, None: 3}, 13, 4
    p = {w: (followers.get(w, 0) + 2.0 * (c + 1) / (n + v + 1)) / (4 + 2.0) for w, c in counts.items()}
    assert sum(p.values()) + 2.0 / (n + v + 1) / 6.0 == pytest.approx(1)
    df = spark.createDataFrame(list(enumerate([*texts, "a", "a never"])), "doc_id long, text string")
    rows = {r["doc_id"]: r["score"] for r in lm.score(df, F.col("doc_id") < 3, weight=2.0).collect()}
    begin = (1 + 2.0 * (4 + 1) / (n + v + 1)) / (3 + 2.0)
    assert rows[3] == pytest.approx(np.log10(begin * p[None]))
    # an unknown word leaves its history by the failure arc, and is no history itself
    assert rows[4] == pytest.approx(np.log10(begin * (2.0 / 18 / 6.0) * (3 + 1) / 18))


def test_lm_odd_rows_and_empty(spark, odd):
    rows = lm.score(odd, F.col("doc_id") % 2 == 0).collect()
    assert len(rows) == odd.count()
    assert all(np.isfinite(r["score"]) and r["n_tokens"] == len(words(t)) + 1 for r in rows for t in [next(x["text"] for x in odd.collect() if x["doc_id"] == r["doc_id"])] if r["doc_id"] != 20)
    assert lm.score(empty(spark), F.lit(True)).count() == 0


# quality

def test_quality_separates_and_handles_odd_rows(spark, odd):
    rng = random.Random(3)
    rows = [(i, prose(rng, 80) if i % 3 else "!! ".join(w.upper() for w in prose(rng, 80).split()), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (7, None), (8, 5)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.col("doc_id") % 4 != 2)
    got = quality.score(docs, model, name="s").collect()
    assert np.mean([(r["s"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] % 4 == 2]) > 0.97
    out = quality.score(odd, model, name="s")
    assert out.count() == odd.count() and out.filter("s >= 0 and s <= 1").count() == odd.count() and set(odd.columns) < set(out.columns)
    nothing = quality.train(docs, labels.limit(0), F.lit(True))
    assert quality.score(docs, nothing, name="s").filter("s = 0.5").count() == 400
    assert quality.score(empty(spark), model, name="s").count() == 0


def test_flat_trees_equal_plain_descent():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)
    margin = []
    for row in x:
        total = model.start
        for t in range(20):
            n = 0
            for _ in range(3):
                n = 2 * n + 1 + int(row[model.feature[t * 15 + n]] > model.threshold[t * 15 + n])
            total += model.value[t * 15 + n]
        margin.append(total)
    assert np.allclose(model.margin(x), margin)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


# archives

def test_warc_round_trip(spark):
    rows = [(3, "http://a/1", "same é"), (1, "http://a/2", "same é"), (2, None, None), (4, "u\r\nx", ""), (5, "http://a/5", "x" * 300_000), (None, "n", "same é"), (1, "http://a/2", "same é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).repartition(3)
    folder = warc.archive_folder(pages)
    index = warc.write(pages, folder, most=1 << 12)
    got = warc.read(index, folder, most=1 << 14).collect()
    assert len(got) == 7 and all(r["sound"] for r in got)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {(3, "revisit", 1), (1, "response", None), (2, "response", None), (4, "revisit", 2), (5, "response", None), (None, "response", None)}
    assert {r["payload_bytes"] for r in got if r["page_id"] in (1, 3)} == {7}
    assert next(bytes(r["payload"]) for r in got if r["page_id"] == 5) == b"x" * 300_000
    chosen = warc.read(index.filter("page_id = 5"), folder).collect()
    assert [r["page_id"] for r in chosen] == [5]
    none = pages.limit(0)
    assert warc.read(warc.write(none, folder), folder).count() == 0


# sharding

def test_sharding_law(spark, odd):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).unionByName(odd.select("doc_id", "text"))
    rows = sharding.shard(docs, sharding.layout(8), rows_per_bucket=100).collect()
    assert len(rows) == docs.count()
    for s in range(8):
        mine = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert 350 < len(mine) < 680
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert 350 < sum(r["grown_shard"] == 8 for r in rows) < 550
    assert sharding.shard(empty(spark), sharding.layout(8)).count() == 0


def test_moves_stay_in_changed_subtrees(spark):
    tree = sharding.layout(8)
    heavier = [s if s.number != 5 else sharding.Shard(s.region, s.rack, 5, 3.0) for s in tree]
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    rows = sharding.place(sharding.place(df, "k", tree, "a"), "k", heavier, "b").collect()
    region = {s.number: s.region for s in tree}
    # rows of the region whose weight grew never leave it
    assert all(region[r["b"]] == region[5] for r in rows if region[r["a"]] == region[5])
    assert all(r["b"] == r["a"] or region[r["b"]] == region[5] for r in rows)
    share = sum(r["b"] == 5 for r in rows) / 3000
    assert abs(share - 0.3) < 0.05


# fingerprints

def test_sketches_estimate(spark):
    rng = random.Random(2)
    a = prose(rng, 600)
    b = a[:len(a) * 3 // 4] + prose(rng, 150)
    k, width = 256, 12
    import pyarrow as pa
    x, y = fingerprints.sketches(pa.array([a, b]), k, width)
    sets = [{t[max(0, e - width):e] for e in range(1, len(t) + 1)} for t in (a, b)]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(fingerprints.resemblance(x, y, k) - true) < 0.12
    assert abs(fingerprints.containment(x, y, k) - len(sets[0] & sets[1]) / len(sets[0])) < 0.15
    assert abs(fingerprints.distinct_count(x, k) / len(sets[0]) - 1) < 0.25
    halves = fingerprints.sketches(pa.array([a[:1000], a[1000 - width + 1:]]), k, width)
    assert len(np.setdiff1d(x, fingerprints.merge(*halves, k))) < k * 0.1
    assert (fingerprints.from_text(fingerprints.to_text(x)) == x).all()


def test_edited_follows_ids(spark, odd):
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r["doc_id"]: r for r in fingerprints.edited(docs.repartition(4)).collect()}
    texts = dict(sorted((r["doc_id"], r["text"] or "") for r in docs.collect()))
    ids = list(texts)
    for i, follower in zip(ids, ids[1:] + ids[:1]):
        assert rows[i]["edited_text"] == fingerprints.edit(texts[i], texts[follower]) and rows[i]["n_chars"] == len(texts[i])
    many = spark.range(50).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    held, rows = fingerprints.with_next(many, rows=7), fingerprints.edited(many)
    assert held.filter("own").count() == 50 and rows.count() == 50
    assert fingerprints.edited(odd).count() == odd.count()
    same = fingerprints.fingerprint(odd).filter("doc_id in (3, 21)").select("fingerprint").distinct().count()
    assert same == 2
    assert fingerprints.edited(empty(spark)).count() == 0


# inner products

@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_top_k_is_exact(spark, spread):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 12))
    x = centre[rng.integers(0, 6, 700)] + 0.05 * rng.normal(size=(700, 12))
    x *= np.exp(spread * rng.normal(size=(700, 1)))
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows + [(900, None), (901, [1.0, None] * 6), (902, [float("nan")] * 12), (None, [1.0] * 12), (3, rows[3][1])], "vec_id long, embedding array<double>").withColumn("level", F.lit("x"))
    got = mips.top_k(df, F.col("vec_id") % 20 == 0, k=7, bucket_rows=60, query_rows=16).collect()
    q = np.floor(64 * x).astype(np.int64)
    want = []
    for i in range(0, 700, 20):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:7]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate(order)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(7)
    x = np.floor(64 * rng.normal(size=(2000, 4))).astype(np.int64)
    bucket = mips.Bucket(np.arange(2000), x)
    for q in x[::50]:
        s = bucket.products(q, slice(None))
        floor = float(np.sort(s)[-10])
        for steep in (0.0, 2.0):
            at = bucket.candidates(q, floor, 3, steep)
            assert (np.sort(bucket.products(q, at))[-10:] == np.sort(s)[-10:]).all()


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in mips.top_k(df, F.col("vec_id") == 0).collect()] == [(0, 1)]
    assert mips.top_k(df.limit(0), F.lit(True)).count() == 0


# components, lines, near duplicates

def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_set(line, width=10):
    return {line[i:i + width] for i in range(max(1, len(line) - width + 1))}


def test_lines_against_brute_force(spark):
    rng = random.Random(11)
    base = [prose(rng, 30) for _ in range(40)]

    def vary(line):
        w = line.split()
        w[rng.randrange(len(w))] = "changed" + str(rng.randrange(99))
        return " ".join(w)

    docs = [(i, "\n".join((vary(rng.choice(base)) if rng.random() < 0.4 else prose(rng, 25)) for _ in range(6)) + "\nshort") for i in range(60)]
    docs += [(i, docs[i - 60][1].upper()) for i in range(60, 70)]
    rows = lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    kept, places = [], []
    for (i, text), r in zip(docs, rows):
        all_lines = text.split("\n")
        assert r["n_lines"] == 7 and r["n_lines"] - r["n_removed"] == len(r["text"].split("\n") if r["text"] else [])
        places += [(l.lower(), i) for l in all_lines if len(l) >= 16]
        kept += [l.lower() for l in (r["text"] or "").split("\n") if len(l) >= 16]
    sets = [line_set(l) for l, _ in places]
    parent = list(range(len(places)))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(places)):
        for b in range(a):
            if places[a][0] == places[b][0] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = sorted(places[n][0] for n in {find(n) for n in range(len(places))})
    assert len(want) <= len(kept) <= len(want) * 1.05
    assert set(want) <= set(kept)


def test_lines_are_told_apart_by_all_their_characters(spark):
    pair = [("https://www.a.org/about/the/people", "https://www.b.org/imprint?lang=en&v=2"),
            ("春天的早晨阳光照在窗台上鸟儿在树枝间歌唱孩子们走路去学校", "春天的早晨阳光照在窗台上商人打开店门准备一天的买卖和账目"),
            ("session-id-0000-4f2a9c71d0e8b35a77", "session-id-0000-b81e6d3c920f5a4411"),
            ("\U0001F600\U0001F601" * 6 + "abcdefghijklmnop", "\U0001F600\U0001F601" * 6 + "qrstuvwxyz012345")]
    copies = [("x" * 70 + "".join(map(str, range(60))), "x" * 70 + "".join(map(str, range(59))) + "5!")]
    texts = [t for p in pair + copies for t in p]
    rows = lines.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in rows] == [0] * 9 + [1]
    short = spark.createDataFrame([(1, "a" * 9), (2, "ab\U0001F600" * 60)], "h long, line string")
    got = {(r["h"], r["s"]) for r in lines._each_shingle(short, 10).collect()}
    runs = spark.createDataFrame([(r["h"], s) for r in short.collect() for s in line_set(r["line"])], "h long, s string")
    assert got == {(r["h"], r["s"]) for r in runs.select("h", F.xxhash64("s").alias("s")).collect()} and len(got) == 1 + 3
    assert got == {(r["h"], r["s"]) for r in short.select("h", F.explode(lines.shingles(F.col("line"), 10)).alias("s")).collect()}


def test_lines_of_one_template_against_brute_force(spark):
    rng = random.Random(17)
    fresh = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    head, source = fresh(140), fresh(200)
    family = [head + fresh(22) for _ in range(160)]  # about 0.75 alike
    family += [t[:-2] + fresh(2) for t in family[:60]]  # each near to one of them only
    star = [source] + [source[:i] + "0" + source[i + 1:] for i in rng.sample(range(20, 180), 80)]  # near to their source
    texts = family + star
    sets = [{t[i:i + 10] for i in range(len(t) - 9)} for t in texts]
    parent = list(range(len(texts)))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if find(i) != i}
    rows = lines.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    gone = {r["doc_id"] for r in rows if r["n_removed"]}
    assert len(want) == 140 and gone <= want and len(want - gone) <= 2


def test_lines_of_a_family_are_paired_once(spark, monkeypatch):
    """Near copies meet the leaders of their buckets, not one another: pairs grow with the lines, not with their square."""
    rng = random.Random(31)
    source = "".join(rng.choice(string.ascii_lowercase) for _ in range(300))
    texts = [source[:i] + "0" + source[i + 1:] for i in rng.sample(range(300), 46)]
    counts, linked = [], lines.linked

    def counted(pairs, *args, **more):
        counts.append(pairs.count())
        return linked(pairs, *args, **more)

    monkeypatch.setattr(lines, "linked", counted)
    rows = lines.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(r["n_removed"] for r in rows) == 45
    assert sum(counts) <= 6 * len(texts), counts


def test_lines_odd_rows(spark, odd):
    out = lines.line_dedup(odd)
    assert out.count() == odd.count() and set(odd.columns) | {"n_lines", "n_removed"} == set(out.columns)
    rows = out.filter("doc_id < 10").collect()
    assert {r["text"] for r in rows} == set(ODD)
    assert lines.line_dedup(empty(spark)).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(13)
    texts = [prose(rng, rng.randrange(1, 90)) for _ in range(150)]
    for source in texts[:25]:
        for _ in range(4):
            w = source.split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = "new" + str(rng.randrange(999))
            texts.append(" ".join(w))
    star = prose(rng, 120)
    for _ in range(150):  # copies that are close to their source but not to one another
        w = star.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = "own" + str(rng.randrange(9999))
        texts.append(" ".join(w))
    texts += [star, star.upper(), star, None, "", "word", "Word"]
    rng.shuffle(texts)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=2, small=16).collect()}
    sets = [shingle_set(t, 2) for t in texts]
    parent = list(range(len(texts)))

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(texts)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    wrong = [i for i in range(len(texts)) if got[i]["component_id"] != find(i)]
    assert len(wrong) <= 0.01 * len(texts), wrong
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_duplicates_of_one_template(spark):
    rng = random.Random(29)
    fresh = lambda n: [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    head = fresh(171)
    texts, pairs = [], 300
    for _ in range(pairs):  # two documents at 0.81, about 0.74 from all others
        own = fresh(30)
        texts += [" ".join([*head, *own, *fresh(1)] if i else [*head, *own[:19], *fresh(11)]) for i in range(2)]
    sets = [shingle_set(t, 2) for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(like(2 * i, 2 * i + 1) >= 0.8 for i in range(pairs)) and max(like(2 * i, j) for i in range(50) for j in range(2 * pairs) if j // 2 != i) < 0.8
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=2, at_once=1 << 14).collect()}
    assert all(c // 2 == i // 2 for i, c in got.items())
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(pairs)) >= 0.97 * pairs


def test_near_duplicates_leave_no_large_tables(spark, monkeypatch):
    """Minwise tokens and whole sets are deleted from the shared folder as soon as nothing reads them."""
    rng, staged, stage = random.Random(37), [], near_dup.stage
    star = prose(rng, 120).split()
    texts = [" ".join(star[:i] + ["own" + str(n)] + star[i + 1:]) for n, i in enumerate(rng.sample(range(120), 90))]

    def kept(df):
        staged.append(stage(df))
        return staged[-1]

    monkeypatch.setattr(near_dup, "stage", kept)
    got = near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=2, small=16)
    assert {r["component_id"] for r in got.collect()} == {0}
    large = [df.staged_at for df in staged if {"tokens", "held", "d"} & set(df.columns)]
    assert len(large) > 3 and not any(os.path.exists(path) for path in large)


def test_near_duplicates_odd_rows(spark, odd):
    rows = near_dup.near_duplicates(odd).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted({r["doc_id"] for r in odd.collect() if r["doc_id"] is not None})
    assert {r["doc_id"] for r in rows if not r["n_shingles"]} == {0, 1, 2}
    assert near_dup.near_duplicates(empty(spark)).count() == 0


# mixing

def test_rates_meet_targets(spark):
    rng = random.Random(17)
    alphabets = {"x": "abcdefgh ", "y": "mnopqrst ", "z": "uvwxyzkl "}
    rows = [(i, "".join(rng.choice(alphabets[d]) for _ in range(rng.randrange(20, 400))), d) for i in range(600) for d in ["xxxyyz"[i % 6]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    targets = {"x": 0.2, "y": 0.3, "z": 0.5}
    model, table = mixing.mix_rates(docs, docs.filter("doc_id < 200").select("doc_id", "domain"), targets)
    got = table.collect()
    p = np.array([r["posterior"] for r in got])
    assert np.allclose(p.sum(1), 1)
    assert np.mean([model.names[int(a)] == "xxxyyz"[r["doc_id"] % 6] for a, r in zip(p.argmax(1), got)]) > 0.97
    mass = (p * np.array([r["rate"] * r["n_tokens"] for r in got])[:, None]).sum(0)
    assert np.allclose(mass / mass.sum(), [targets[n] for n in model.names], atol=2e-3)
    whole = mixing.mix(docs, docs.select("doc_id", "domain"), targets, least=1.0)
    assert whole.select("doc_id").distinct().count() == 600 and whole.columns == docs.columns
    counted = {r["domain"]: r["n"] for r in whole.groupBy("domain").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()}
    assert abs(counted["z"] / sum(counted.values()) - 0.5) < 0.05


def test_mixing_odd_rows(spark, odd):
    labelled = odd.select("doc_id", F.col("lang").alias("domain"))
    assert mixing.mix(odd, labelled, {"en": 1.0}, least=1.0).count() == odd.count()
    assert mixing.mix(odd, labelled.limit(0), {"en": 1.0}).count() <= 2 * odd.count()
    assert mixing.mix(odd.limit(0), labelled, {"en": 1.0}).count() == 0


def test_runs_of_a_line_by_bytes_and_by_characters(spark):
    texts = ["plain ascii of some length, cut by bytes " * 5, "ein Straßenzug über größere Höhen " * 6, "𝒳 beyond the plane 漢字かな交じり文です。" * 4, "short", "naïve", ""]
    held = spark.createDataFrame(list(enumerate(texts)), "h long, line string")
    cut = {r["h"]: sorted(r["s"]) for r in lines._each_shingle(held, 10).groupBy("h").agg(F.collect_list("s").alias("s")).collect()}
    whole = {r["h"]: sorted(r["s"]) for r in held.select("h", lines.shingles(F.col("line"), 10).alias("s")).collect()}
    assert cut == whole


def test_ids_within_a_list(spark):
    table = spark.range(20_000).selectExpr("id * 7 - 900 as h", "id as x")
    got = {r["h"] for r in within(table, "h", spark.range(300).selectExpr("id * 70 - 900 as i"), 300).collect()}
    assert {i * 70 - 900 for i in range(285)} <= got and len(got) < 3000
    assert within(table, "h", spark.range(0), 0).count() == 0


def test_only_sets_that_are_asked_for_travel(spark):
    held = stage(spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as held"))
    pairs = stage(spark.createDataFrame([(1, 2, 9), (2, 3, 8), (10, 11, 7)], "a long, b long, s long"))
    seen = []

    def verified(asked, sets, similarity):
        seen.append(sets.count())
        return asked

    out = {r["node"]: r["component"] for r in near_dup.linked(pairs, held, 0.8, verified).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10}
    assert max(seen) < 500


def test_lines_of_a_large_bucket_meet_a_share_of_it_first(spark):
    rows = [(0, h, 0 if h < 600 else h) for h in range(640)]
    sketch = F.struct(F.lit(100).cast("long").alias("n"), *[F.lit(7).cast("long").alias(f"x{w}") for w in range(lines.WORDS)])
    crowd = stage(spark.createDataFrame(rows, "bucket long, h long, comp long").withColumn("x", sketch))
    pairs = {(r["a"], r["b"]) for r in lines._crowded(crowd, 80).collect()}
    few = {(r["a"], r["b"]) for r in lines._crowded(crowd, 80, 16).collect()}
    assert pairs == {(u, v) for v in range(600, 640) for u in range(v)}
    assert few < pairs and len(few) < len(pairs) / 6
    # every line outside finds the large component
    assert {b for a, b in few if a < 600} == set(range(600, 640))


def test_draws_and_marks_of_lines_are_made_from_rows_of_runs(spark):
    texts = ["plain ascii of some length, cut by bytes " * 5, "ein Straßenzug über größere Höhen " * 6, "𝒳 beyond the plane 漢字かな交じり文です。" * 4, "short", "naïve", "x" * 25, "é" * 26]
    held = spark.createDataFrame(list(enumerate(texts)), "h long, line string")
    runs = {i: max(1, len(t) - 9) for i, t in enumerate(texts)}
    rows = [r for cut in lines._cut(held, 10) for r in cut.collect()]
    # not one row a run
    assert {i: sum(r["h"] == i for r in rows) for i in runs} == {i: -(-n // lines.RUNS) for i, n in runs.items()}
    assert {i: sum(r["n"] for r in rows if r["h"] == i) for i in runs} == runs
    whole = {r["h"]: r["s"] for r in held.select("h", lines.shingles(F.col("line"), 10).alias("s")).collect()}
    for r in lines.parities(held, 10).collect():
        bits = 0
        for s in whole[r["h"]]:
            bits |= 1 << (s % (1 << 64) >> 6) % lines.WORDS * 64 + s % 64
        assert r["n"] == runs[r["h"]] and [r[f"x{w}"] % (1 << 64) for w in range(lines.WORDS)] == [bits >> 64 * w & (1 << 64) - 1 for w in range(lines.WORDS)]
    seeds = [(0x9E3779B97F4A7C15 * (n + 1)) % (1 << 64) - (1 << 63) for n in range(12)]
    drawn = spark.createDataFrame([(h, [min(s ^ seed for s in of) for seed in seeds]) for h, of in whole.items()], "h long, m array<long>")
    want = {r["h"]: r["bs"] for r in drawn.select("h", F.array(*[F.xxhash64(F.lit(b), F.get("m", F.lit(2 * b)), F.get("m", F.lit(2 * b + 1))) for b in range(6)]).alias("bs")).collect()}
    assert {r["h"]: r["bs"] for r in lines.signatures(held, 10, 6, 2).collect()} == want


def test_texts_are_cut_into_lines_once(spark, monkeypatch):
    calls, cut = [], lines._lines
    monkeypatch.setattr(lines, "_lines", lambda *args: calls.append(args) or cut(*args))
    rows = lines.line_dedup(spark.createDataFrame([(1, "Eine Zeile mit ÄÖÜ und mehr \nkurz"), (2, "  eine zeile mit äöü und mehr\nΟΔΟΣ ΠΡΟΣ ΤΗΝ ΠΟΛΗ ΜΑΣ")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert len(calls) == 1
    assert [(r["text"], r["n_removed"]) for r in rows] == [("Eine Zeile mit ÄÖÜ und mehr \nkurz", 0), ("ΟΔΟΣ ΠΡΟΣ ΤΗΝ ΠΟΛΗ ΜΑΣ", 1)]
    held = spark.createDataFrame([("Α Σ \nΌΣΟΣ ΚΑΙ ΟΣ\nİSTANBUL ist WEIT",)], "text string").withColumns({"doc_id": F.lit(1), "row": F.lit(1)})
    assert [r["line"] for r in cut(held, 1).collect()] == [r["line"] for r in held.select(F.explode(F.split("text", "\n")).alias("l")).select(F.lower(F.trim("l")).alias("line")).collect()]
