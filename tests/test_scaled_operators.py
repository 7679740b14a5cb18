"""Operators meant for large groups, against brute force; one key always holds a third or more of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import aggregates as ag
from tidemark.operators import joins as jn
from tidemark.operators import micropanel as mp
from tidemark.operators import ordered as od
from tidemark.operators import retrieval as rt
from tidemark.sources import csv, documents
from tidemark.sources import profile


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 6000
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdef"), n))
    value = np.round(np.where(key == "hot", rng.pareto(2, n) * 100, rng.normal(50, 20, n)), 2)
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "value": value})
    return pdf, spark.createDataFrame(pdf).repartition(4).cache()


def test_quantiles(skewed):
    pdf, df = skewed
    got = od.quantiles(df, ["key"], "value", [0.05, 0.25, 0.5, 0.95]).toPandas().set_index("key")
    for k, g in pdf.groupby("key"):
        assert got.loc[k, ["q05", "q25", "q50", "q95"]].to_list() == pytest.approx(g.value.quantile([0.05, 0.25, 0.5, 0.95]).to_list())


def test_quantiles_of_one_repeated_value(spark):
    df = spark.createDataFrame([("k", 7.0)] * 100, "key string, value double")
    assert od.quantiles(df, ["key"], "value", [0.1, 0.9]).first()[2:] == (7.0, 7.0)


def test_distribution(skewed, monkeypatch):
    pdf, df = skewed
    staged, put = [], ag.stage
    monkeypatch.setattr(ag, "stage", lambda d: staged.append(d) or put(d))
    got = ag.distribution(df, ["key"], "value").toPandas().set_index("key")
    for k, g in pdf.groupby("key"):
        mad = (g.value - g.value.median()).abs().median()
        assert got.loc[k, ["n", "p05", "p95", "mad"]].to_list() == pytest.approx([len(g), g.value.quantile(0.05), g.value.quantile(0.95), mad])
    # values must not meet the median by their group alone, that sorts a group in one task
    joins = [line for line in staged[0]._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [key" in line]
    assert joins and all("_part" in line for line in joins)


def test_running_totals(skewed):
    pdf, df = skewed
    got = od.running(od.value_counts(df, ["key"], "value"), ["key"], "value", ["c"], df, rows=len(pdf) // 7).toPandas()
    counts = pdf.groupby(["key", "value"]).size().rename("c").reset_index().sort_values(["key", "value"])
    counts["before"] = counts.groupby("key").c.cumsum() - counts.c
    merged = got.merge(counts, on=["key", "value"])
    assert len(merged) == len(got) == len(counts) and (merged.before_c == merged.before).all()


def test_more_rows_make_more_ranges(skewed):
    _, df = skewed
    few, many = (len(od._ranges(df, "value", rows)) for rows in (10**9, 20))
    assert few == 2 and many > 10


@pytest.mark.parametrize("size", [2, 29, 30, 200])
def test_gini(spark, size):
    rng = np.random.default_rng(size)
    x = np.round(rng.pareto(1.5, size) * 10, 1)
    df = spark.createDataFrame([("g", float(v)) for v in x], "g string, v double")
    got = mp.gini(df, ["g"], "v", 30).first().gini
    assert mp.gini(df, ["g"], "v").first().gini == pytest.approx(1 - 2 / (size + 1) * np.sum(np.cumsum(np.sort(x)) / (x.sum() + 1e-10)))
    if size < 30:
        want = np.abs(x[:, None] - x[None]).sum() / (2 * size * x.sum() + 1e-10) / ((size - 1) / size)
    else:
        want = 1 - 2 / (size + 1) * np.sum(np.cumsum(np.sort(x)) / (x.sum() + 1e-10))
    assert got == pytest.approx(want) and 0 <= got <= 1


def test_auc(skewed):
    pdf, df = skewed
    truth = (pdf.value + np.random.default_rng(0).normal(0, 40, len(pdf)) > 60).astype(int)
    sdf = df.sparkSession.createDataFrame(pdf.assign(truth=truth, flag=(pdf.value > 60).astype(int), score=pdf.value.round(0)))
    got = ag.detector_quality(sdf, ["key"], "truth", "flag", "score").toPandas().set_index("key").auc
    for k, g in pdf.assign(truth=truth, score=pdf.value.round(0)).groupby("key"):
        r = g.score.rank()
        p, n = (g.truth == 1).sum(), (g.truth == 0).sum()
        assert got[k] == pytest.approx((r[g.truth == 1].sum() - p * (p + 1) / 2) / (p * n))


def test_asof_against_pandas(spark):
    rng = np.random.default_rng(5)
    n = 3000
    start = pd.Timestamp("2024-01-01")
    left = pd.DataFrame({"id": np.arange(n), "key": np.where(rng.random(n) < 0.5, "hot", "cold"), "ts": start + pd.to_timedelta(rng.integers(0, 90 * 86400, n), unit="s")})
    right = pd.DataFrame({"key": rng.choice(["hot", "cold"], 40), "ts": start + pd.to_timedelta(rng.integers(10, 60, 40), unit="D"), "level": rng.normal(size=40)})
    right = right.sort_values(["ts", "level"]).drop_duplicates(["key", "ts"], keep="last")
    schema = "id long, key string, ts timestamp_ntz"
    got = jn.asof_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, "key string, ts timestamp_ntz, level double"), ["key"], "ts", ["level"], "month").toPandas()
    want = pd.merge_asof(left.sort_values("ts"), right.sort_values("ts"), on="ts", by="key")
    first = right.sort_values("ts").groupby("key")["level"].first()
    want["level"] = want.level.fillna(want.key.map(first))
    assert len(got) == n
    assert got.sort_values("id").level.to_list() == pytest.approx(want.sort_values("id").level.to_list())


def test_asof_without_backfill_keeps_early_rows(spark):
    left = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-05")], "id int, d string").select("id", F.col("d").cast("timestamp_ntz").alias("ts"), F.lit("k").alias("key"))
    right = spark.createDataFrame([("2024-02-01", 5.0)], "d string, level double").select(F.col("d").cast("timestamp_ntz").alias("ts"), "level", F.lit("k").alias("key"))
    got = {r.id: r.level for r in jn.asof_join(left, right, ["key"], "ts", ["level"], backfill=False).collect()}
    assert got == {1: None, 2: 5.0}


def test_interval_join_counts_each_pair_once(spark):
    points = spark.range(0, 100).select(F.lit("k").alias("key"), F.date_add(F.lit("2024-01-15").cast("date"), F.col("id").cast("int")).alias("d"))
    spans = spark.createDataFrame([("k", "2024-01-20", "2024-03-10"), ("k", "2024-02-01", "2024-02-03")], "key string, s string, e string").select("key", F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"))
    assert jn.interval_join(points, spans, ["key"], "d", "s", "e").count() == 51 + 3


def test_nearest_start_prefers_the_earlier(spark):
    days = spark.createDataFrame([("2024-01-06",), ("2024-12-31",)], "d string").select(F.col("d").cast("date").alias("d"))
    starts = spark.createDataFrame([("2024-01-01",), ("2024-01-11",), ("2025-01-05",)], "s string").select(F.col("s").cast("date").alias("s"))
    got = {str(r.d): r.days_to_start for r in jn.nearest_start(days, "d", starts, "s").collect()}
    assert got == {"2024-01-06": 5, "2024-12-31": -5}


def test_nearest_start_reaches_any_distance(spark):
    far = ("1950-06-01", "1993-03-01", "1995-01-01", "1998-01-01", "2003-05-01", "2040-01-01")
    days = spark.createDataFrame([(d,) for d in far], "d string").select(F.col("d").cast("date").alias("d"))
    starts = spark.createDataFrame([("1995-01-30",), ("2001-01-23",), (None,)], "s string").select(F.col("s").cast("date").alias("s"))
    import datetime
    known = [datetime.date(1995, 1, 30), datetime.date(2001, 1, 23)]
    want = {d: min(((datetime.date.fromisoformat(d) - s).days for s in known), key=abs) for d in far}
    assert {str(r.d): r.days_to_start for r in jn.nearest_start(days, "d", starts, "s").collect()} == want
    assert jn.nearest_start(days, "d", starts.limit(0), "s").filter("days_to_start IS NULL").count() == len(far)


def test_asof_join_without_keys(spark):
    left = spark.range(0, 60).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 3).cast("int")).alias("d"))
    right = spark.createDataFrame([("2024-01-20", 1), ("2024-01-25", 2), ("2024-04-02", 3)], "d string, v int").select(F.col("d").cast("date").alias("d"), "v")
    got = {str(r.d): r.v for r in jn.asof_join(left, right, [], "d", ["v"]).collect()}
    assert len(got) == 60 and all(v == (1 if d < "2024-01-25" else 2 if d < "2024-04-02" else 3) for d, v in got.items())


def test_brackets_share_end_points(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (11.0,)], "v double")
    name = jn.bracket_of(F.col("v"), [(0.0, 5.0, "low"), (5.0, 10.0, "high")])
    assert [r[0] for r in df.select(name).collect()] == ["low", "high", "high", None]


def test_cosine_against_numpy(spark):
    rng = np.random.default_rng(8)
    x, q = rng.normal(size=(300, 16)), rng.normal(size=(7, 16))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, w array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {i: list(np.argsort(-row)[:5]) for i, row in enumerate(unit(q) @ unit(x).T)}
    saved, rt.BLOCK = rt.BLOCK, 3  # more than one block of queries
    try:
        got = rt.cosine_topk(vectors, "id", ["v"], asked, "q", ["w"], 5).toPandas()
    finally:
        rt.BLOCK = saved
    assert {k: g.sort_values("rank").id.to_list() for k, g in got.groupby("q")} == want


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "load falls load"), (2, "load rises"), (3, "weather")], "id int, text string")
    asked = spark.createDataFrame([(1, "load load weather")], "q int, ask string")
    got = {r.id: r.score for r in rt.bm25(docs, "id", F.col("text"), asked, "q", F.col("ask")).collect()}
    avg, idf = 2.0, lambda df: np.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))
    assert got == pytest.approx({1: 2 * idf(2) * part(2, 3), 2: 2 * idf(2) * part(1, 2), 3: idf(1) * part(1, 1)})


def test_taxes(spark):
    df = spark.createDataFrame([(1, 50000.0, 1e9), (2, 1000.0, 20.0), (3, -5.0, 10.0)], "agent int, income double, coin double").withColumn("year", F.lit(1))
    rows = {r.agent: r for r in mp.enact_taxes(df, "year", "agent", "income", "coin").collect()}
    due = 0.1 * 9700 + 0.12 * (39475 - 9700) + 0.22 * (50000 - 39475)
    assert rows[1].tax_paid == pytest.approx(due) and rows[1].marginal_rate == 0.22 and rows[2].tax_paid == 20.0 and rows[3].tax_paid == 0.0
    assert sum(r.lump_sum for r in rows.values()) == pytest.approx(sum(r.tax_paid for r in rows.values()))


def test_bracket_spacings():
    assert mp.bracket_cutoffs("linear", 3, 100.0) == [0.0, 50.0, 100.0]
    log = mp.bracket_cutoffs("log", 4, 100.0)
    assert log == pytest.approx([0.0, 25.0, 50.0, 100.0])


def test_income_bins_and_rates(spark):
    incomes = [5.0, 15.0, 15.0, 95.0, 100.0, 150.0, 250.0]
    df = spark.createDataFrame([("y", v) for v in incomes], "y string, z double")
    bins = mp.income_bins(df, ["y"], "z", top=100.0, n_bins=10).orderBy("bin").collect()
    assert [round(b.pz * 7) for b in bins] == [1, 2, 0, 0, 0, 0, 0, 0, 0, 2, 2]  # the last edge is inclusive, the open bin last
    assert bins[2].a is None and bins[10].a == pytest.approx(200 / (200 - 100 + 1e-9))
    rates = [r.rate for r in mp.optimal_rates(mp.income_bins(df, ["y"], "z", 100.0, 10), ["y"], 0.5).orderBy("bin").collect()]
    assert rates[2:9] == pytest.approx(list(np.linspace(rates[1], rates[9], 9)[1:-1]))


def test_keep_first_and_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("period,name,value\n2024-01-02,用电,5\n2024-01-01,用电,3\n2024-01-01,用电,4\n".encode("gbk"))
    got = csv.read_csv(spark, str(tmp_path / "a.csv"), StructType.fromDDL("period date, name string, value double"), "period")
    assert sorted((str(r.period), r.name, r.value) for r in got.collect()) == [("2024-01-01", "用电", 3.0), ("2024-01-02", "用电", 5.0)]


def test_packed_chunks_follow_the_greedy_rule(spark):
    rng = np.random.default_rng(2)
    paras = ["x" * int(n) for n in rng.integers(1, 120, 60)]
    want, buf = [], ""
    for p in paras:
        if buf and len(buf) + len(p) > 220:
            want.append(buf)
            buf = p
        else:
            buf = buf + "\n" + p if buf else p
    want.append(buf)
    df = spark.createDataFrame([(1, "\n \n".join(paras)), (2, "  ")], "id int, text string")
    assert [r.chunk for r in documents.packed_chunks(df, "id", "text").orderBy("chunk_no").collect()] == want


def test_value_column_choice(spark):
    df = spark.createDataFrame([(f"2024-{m:02d}", float(m), float(m * 10), 1.0, m) for m in range(1, 13)], "month string, consumption_month double, consumption_ytd double, constant double, yoy_pct int")
    rows = {r.column: r.chosen for r in profile.value_columns(df, "month").collect()}
    assert rows == {"consumption_month": True, "consumption_ytd": False}
    assert [r.column for r in profile.period_columns(df).filter("chosen").collect()] == ["month"]


def test_tasks_of_a_search_hold_few_texts_at_a_time(spark, monkeypatch):
    # what a task holds beside its batch must not follow the size of the batch
    import tracemalloc
    import pyarrow as pa

    texts = spark.createDataFrame([(0, "some words")], "id long, t string")
    seen, Frame = [], type(texts)
    true = Frame.mapInArrow
    monkeypatch.setattr(Frame, "mapInArrow", lambda self, f, *a, **k: seen.append(f) or true(self, f, *a, **k))
    asked = rt.packed(texts.select(F.col("id").alias("q"), "t"), "q", F.col("t"))
    rt.cosine_topk(rt.packed(texts, "id", F.col("t")), "id", ["buckets", "weights"], asked, "q", ["buckets", "weights"])
    rng = np.random.default_rng(1)
    n = 10_000
    words = ["".join(w) for w in rng.choice(list("abcdefghij"), (n, 60))]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(words)], names=["id", "t"])
    tracemalloc.start()
    made = list(seen[1](iter([batch])))
    small = tracemalloc.get_traced_memory()[1]
    whole = pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    tracemalloc.reset_peak()
    best = list(seen[2](iter([whole])))
    search = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert whole.num_rows == n and sum(b.num_rows for b in best) == 4
    assert small < 48 << 20 and search < 48 << 20, (small, search)


def test_tasks_of_a_ranking_hold_few_pairs_at_a_time(spark, monkeypatch):
    import tracemalloc
    import pyarrow as pa

    docs = spark.createDataFrame([(1, "ann bob cat dog")], "id long, t string")
    asked = spark.createDataFrame([(i, "ann bob cat dog") for i in range(200)], "q long, ask string")
    seen, Frame = [], type(docs)
    true = Frame.mapInArrow
    monkeypatch.setattr(Frame, "mapInArrow", lambda self, f, *a, **k: seen.append(f) or true(self, f, *a, **k))
    rt.bm25(docs, "id", F.col("t"), asked, "q", F.col("ask"))
    n = 5000
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([["ann", "bob", "cat", "dog"]] * n)], names=["id", "_t"])
    tracemalloc.start()
    best = list(seen[0](iter([batch])))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in best) == 200 * 4
    assert held < 24 << 20, held
