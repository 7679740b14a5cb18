"""The registered queries of the operators, each beside the SQL that gives the same rows where there is one."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Tables, rounded
from . import clusters, divergence, fingerprints, graph, lines, lm, mips, mixing, near_dup, packing, quality, sharding, warc

#: Weights that the mixing query and the pipeline aim at, by language.
TARGETS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}
#: Least score of a document that counts as good.
GOOD = 0.7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return register


def remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _crc_sql(hexed: str) -> str:
    """CRC-32 of the bytes written in hexadecimal: the register is shifted bit by bit, eight times a byte."""
    bit = "CASE WHEN ({v} & 1) = 1 THEN xor({v} >> 1, 3988292384) ELSE {v} >> 1 END"
    step = "list_reduce([xor(a, b)] || range(8), lambda v, i: " + bit.format(v="v") + ")"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all({hexed}, '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: {step}), 4294967295)"


def _words_sql(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+')"


@_query("op1_packing")
def op1(t: Tables) -> DataFrame:
    """Every document in pieces of sequences of 2048 tokens."""
    pieces = packing.pack(t.documents, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@_query("op2_lm_scoring", f"""
WITH w AS (SELECT doc_id, {_crc_sql("hex(encode(CAST(doc_id AS VARCHAR)))")} % 7 = 2 AS held_out, {_words_sql("text")} AS w FROM documents),
s AS (SELECT doc_id, held_out, list_concat(['<s>'], list_transform(w, lambda x: 'w' || x), ['</s>']) AS s FROM w),
g AS (SELECT doc_id, held_out, unnest(s[:-2]) AS h, unnest(s[2:]) AS w FROM s),
u AS (SELECT w, count(*) AS c FROM g WHERE NOT held_out GROUP BY 1), b AS (SELECT h, w, count(*) AS c FROM g WHERE NOT held_out GROUP BY 1, 2),
n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM u), c AS (SELECT w AS h, c FROM u WHERE w <> '</s>' UNION ALL SELECT '<s>', c FROM u WHERE w = '</s>'),
p AS (SELECT doc_id, held_out, n, coalesce(u.c, 0) AS cw, (coalesce(u.c, 0) + 1.0::DOUBLE) / (n + v + 1) AS p, coalesce(b.c, 0) AS cb, coalesce(c.c, 0) AS ch FROM g CROSS JOIN n LEFT JOIN u USING (w) LEFT JOIN b USING (h, w) LEFT JOIN c USING (h))
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (cw > 0) AS n_known, max(n) AS train_tokens, floor(sum(log10(p)) * 1e6 + 0.5) / 1e6 AS base_score,
 floor(sum(log10(CASE WHEN ch > 0 THEN (cb + 20.0::DOUBLE * p) / (ch + 20.0::DOUBLE) ELSE p END)) * 1e6 + 0.5) / 1e6 AS score FROM p GROUP BY 1, 2""")
def op2(t: Tables) -> DataFrame:
    """Log-probability of every text; documents with remainder 2 are not learnt from."""
    scored = lm.score(t.documents, remainder(7) != 2)
    return rounded(scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))


@_query("op3_quality_classifier")
def op3(t: Tables) -> DataFrame:
    """Quality of every text; labels with remainder 2 are not learnt from."""
    model = quality.train(t.documents, t.labels, remainder(4) != 2)
    scored = quality.score(t.documents, model, name="score")
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


@_query("op4_warc", """
WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, strlen(html) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b""")
def op4(t: Tables) -> DataFrame:
    """Every page written to WARC archives and read back by its byte range."""
    folder = warc.archive_folder(t.pages)
    records = warc.read(warc.write(t.pages, folder), folder)
    # a payload that does not agree with its headers fails the query
    fine = F.when(F.col("sound"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("damaged record")).cast("long"))
    return records.select("page_id", fine.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def _place_sql(parents: dict[str, dict[str, float]], name: str) -> str:
    """Three common table expressions that descend a tree by the smallest draw."""
    out, before = [], "k0"
    for level in range(3):
        rows = [(p, c, w) for p, cs in parents.items() for c, w in cs.items() if (0 if p == "" else p.count("/") + 1) == level]
        values = ", ".join(f"('{p}', '{c}', {w}::DOUBLE)" for p, c, w in rows)
        at = "''" if level == 0 else "node"
        out.append(f"{name}{level} AS (SELECT r, arg_min(v.node, -ln((('0x' || substr(md5(k || '|' || v.node), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE) / weight) AS node FROM (SELECT r, k, {at} AS parent FROM {'k0' if level == 0 else f'(SELECT k0.r, k, node FROM k0 JOIN {name}{level - 1} USING (r))'}) JOIN (VALUES {values}) v(parent, node, weight) USING (parent) GROUP BY r)")
    return ", ".join(out)


def _tree_sql(tree: list[sharding.Shard]) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for s in tree:
        path = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.number}"]
        for p, c in zip(path, path[1:]):
            out.setdefault(p, {})[c] = out.get(p, {}).get(c, 0.0) + s.weight
    return out


@_query("op5_sharding", f"""
WITH k0 AS (SELECT doc_id, row_number() OVER () AS r, CAST(doc_id AS VARCHAR) AS k, coalesce(text, '') AS text FROM documents),
{_place_sql(_tree_sql(sharding.layout(8)), "a")}, {_place_sql(_tree_sql(sharding.grown(sharding.layout(8))), "g")}
SELECT doc_id, strlen(text) + 1 AS size, {_crc_sql("hex(encode(text))")} AS text_crc32, 'key' AS law, CAST(split_part(a2.node, '/', 3) AS INTEGER) AS shard,
 row_number() OVER (PARTITION BY a2.node ORDER BY md5(k), doc_id) - 1 AS slot, CAST(split_part(g2.node, '/', 3) AS INTEGER) AS grown_shard FROM k0 JOIN a2 USING (r) JOIN g2 USING (r)""")
def op5(t: Tables) -> DataFrame:
    """Every document on one of eight shards, and where it would be with nine."""
    placed = sharding.shard(t.documents, sharding.layout(8))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@_query("op6_fingerprints")
def op6(t: Tables) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are."""
    held = fingerprints.edited(t.documents)
    return held.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@_query("op7_topk_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[]) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20""")
def op7(t: Tables) -> DataFrame:
    """The 20 highest inner products of every twentieth vector."""
    return mips.top_k(t.embeddings, F.col("vec_id") % 20 == 0)


@_query("op8_line_dedup")
def op8(t: Tables) -> DataFrame:
    """Every document without the lines that another place of the corpus has already, nearly or exactly."""
    return lines.line_dedup(t.documents).select("doc_id", "n_lines", "n_removed", "text")


@_query("op9_near_dedup", f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2]) ELSE w END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS c FROM r GROUP BY 1) m USING (doc_id)""")
def op9(t: Tables) -> DataFrame:
    """Near-duplicate classes of all documents over two-word shingles."""
    return near_dup.near_duplicates(t.documents, words=2)


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mixing step: language of the documents that have labels."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


@_query("op10_mixing")
def op10(t: Tables) -> DataFrame:
    """Expected and whole copies of every document, for target weights by language; documents of domains that have too much may go."""
    model, table = mixing.mix_rates(t.documents, labelled_languages(t.documents, t.labels), TARGETS)
    return table.select("doc_id", "n_tokens", "posterior", "rate", "copies")


def _rounds_sql(rounds: int) -> str:
    """Common table expressions of all rounds: distances by inner products, sums column by column."""
    near = "SELECT r, vec_id, min({{d: d, c: c}}) AS p FROM (SELECT v.r, v.vec_id, c.c, CAST(list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT) AS d FROM v CROSS JOIN c{n} c) GROUP BY r, vec_id"
    out = []
    for n in range(rounds):
        out.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        out.append(f"s{n} AS (SELECT c, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM (SELECT a.p.c AS c, i, sum(v.x[i]::BIGINT) AS s, count(*) AS n FROM a{n} a JOIN v USING (r) CROSS JOIN range(1, 65) g(i) GROUP BY 1, 2) GROUP BY c)")
        out.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(s.x, b.x) AS x FROM c{n} b LEFT JOIN s{n} s USING (c))")
    return ", ".join([*out, f"a AS MATERIALIZED ({near.format(n=rounds)})"])


@_query("op11_clusters", f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), x) - 1 AS c, x FROM v ORDER BY c LIMIT 40), {_rounds_sql(5)}
SELECT vec_id, CAST(a.p.c AS INTEGER) AS cluster, a.p.d AS distance, CAST(sum(a.p.d) OVER (PARTITION BY a.p.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.p.d) OVER () AS BIGINT) AS inertia,
 sha256(list_aggregate(list_transform(c5.x, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256 FROM a JOIN c5 ON c5.c = a.p.c""".replace("{{", "{").replace("}}", "}"))
def op11(t: Tables) -> DataFrame:
    """All vectors in forty clusters, with the inertia of each and of all."""
    return clusters.clusters(t.embeddings, k=40, rounds=5)


@_query("op12_near_vectors", """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
s AS MATERIALIZED (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id FROM s a JOIN s b ON len(a.x) = len(b.x) AND a.r <> b.r WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
w AS (SELECT r, r AS node, vec_id FROM v UNION SELECT w.r, e.b, e.vec_id FROM w JOIN e ON e.a = w.node)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, v.vec_id IS NOT DISTINCT FROM m.c AS kept FROM v LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) n ON n.a = v.r JOIN (SELECT r, min(vec_id) AS c FROM w GROUP BY 1) m ON m.r = v.r""")
def op12(t: Tables) -> DataFrame:
    """Near-duplicate classes of all vectors by cosine."""
    return graph.near_vectors(t.embeddings)


@_query("op13_divergence", rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d), t AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN t USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM t GROUP BY 1) USING (lang)),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p FROM g JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (any_value(a) + 2 * any_value(v)) AS q FROM c JOIN (SELECT lang, sum(n) AS a, max(v) AS v FROM g GROUP BY 1) USING (lang) GROUP BY 1, 2),
u AS (SELECT lang, source, 'pair' AS part, other AS item, coalesce(value, 0) AS value FROM (SELECT g.lang, g.source, h.source AS other FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source) LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) USING (lang, source, other)
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= 10""")
def op13(t: Tables) -> DataFrame:
    """Divergence of all sources of a language from one another, and the terms that mark each."""
    return divergence.divergence(t.documents)
