"""RET: keyword and vector search over the documents and embeddings."""

from pyspark.sql import functions as F

from ..operators import retrieval as rt
from .registry import query, rounded
from .standins import r

_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"


def _tokens_sql(text):
    return rf"""list_concat(regexp_extract_all(lower({text}), '[a-z0-9_]+'), list_filter(list_transform(list_zip(string_split(regexp_replace(lower({text}), '[^\x{{4e00}}-\x{{9fff}}]', '', 'g'), ''), string_split(regexp_replace(lower({text}), '[^\x{{4e00}}-\x{{9fff}}]', '', 'g'), '')[2:]), lambda z: z[1] || z[2]), lambda x: length(x) = 2))"""


BM25 = f"""d AS (SELECT doc_id, {_tokens_sql("text || ' ' || source")} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS av FROM d),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_tokens_sql('text')}) AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT item_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))) AS score FROM tf JOIN q USING (term) JOIN df USING (term), n GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0)"""


def hits(t, asked=None):
    """The best documents for every benchmark item, or for those in ``asked``."""
    docs = t.documents.select("doc_id", F.concat_ws(" ", "text", "source").alias("text"))
    return rt.bm25(docs, "doc_id", F.col("text"), (t.benchmark if asked is None else asked).withColumnRenamed("text", "ask"), "item_id", F.col("ask"))


@query("ret1_bm25", f"""
WITH {BM25}
SELECT item_id, doc_id, {r('score', 4)} AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 4""")
def ret1(t):
    return rounded(hits(t).select("item_id", "doc_id", "score", "rank"), 4)


def _cells_sql(table, key):
    return rf"""c_{table} AS (SELECT {key}, string_split(regexp_replace(text, '{_SPACE}', '', 'g'), '') AS c FROM {table}),
g_{table} AS (SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest(list_concat(c, list_transform(list_zip(c[:-2], c[2:]), lambda z: z[1] || z[2]))) AS g FROM c_{table}) WHERE g <> '' GROUP BY 1, 2),
b_{table} AS (SELECT {key}, CAST(('0x' || left(md5(g), 8))::BIGINT % 512 AS INTEGER) AS bucket, CAST(sum(n) AS DOUBLE) AS w FROM g_{table} GROUP BY 1, 2),
v_{table} AS (SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM b_{table})"""


@query("ret2_hashed_vectors", f"""
WITH {_cells_sql('documents', 'doc_id')} SELECT doc_id, count(*) AS n_buckets, {r('sum(weight)')} AS total, {r('max(weight)')} AS largest, CAST(arg_max(bucket, (round(weight, 9), -bucket)) AS INTEGER) AS top_bucket, {r('sum(bucket * weight)', 4)} AS moment FROM v_documents GROUP BY 1""")
def ret2(t):
    cells = rt.hashed_vectors(t.documents, "doc_id", F.col("text"))
    return rounded(cells.groupBy("doc_id").agg(
        F.count("*").alias("n_buckets"), F.sum("weight").alias("total"), F.max("weight").alias("largest"),
        F.max_by("bucket", F.struct(F.round("weight", 9), -F.col("bucket"))).alias("top_bucket"), F.sum(F.col("bucket") * F.col("weight")).alias("moment")), 6, moment=4)


@query("ret3_dense_topk", f"""
WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2), q AS (SELECT label, list(x ORDER BY i) AS qv FROM m GROUP BY 1),
s AS (SELECT q.label AS query_label, vec_id, round(list_cosine_similarity(list_transform(embedding, lambda v: v::DOUBLE), qv), 9) AS score FROM embeddings, q),
k AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_label, vec_id, {r('score', 5)} AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def ret3(t):
    # one query per label: the mean of its vectors, coordinate by coordinate
    e = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    asked = means.groupBy(F.col("label").alias("query_label")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("qv"))
    return rounded(rt.cosine_topk(t.embeddings, "vec_id", ["embedding"], asked, "query_label", ["qv"], 10), 5)


@query("ret3_text_topk", f"""
WITH {_cells_sql('documents', 'doc_id')}, {_cells_sql('benchmark', 'item_id')}, s AS (SELECT item_id, doc_id, round(sum(a.weight * b.weight), 9) AS score FROM v_documents a JOIN v_benchmark b USING (bucket) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT item_id, doc_id, {r('score', 5)} AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 4""")
def ret3_text(t):
    docs = rt.packed(t.documents, "doc_id", F.col("text"))
    asked = rt.packed(t.benchmark, "item_id", F.col("text"))
    return rounded(rt.cosine_topk(docs, "doc_id", ["buckets", "weights"], asked, "item_id", ["buckets", "weights"]), 5)
