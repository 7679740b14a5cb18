"""Tables without a description, and folders of text files."""

from pyspark.sql import functions as F

from tidemark.sources import documents, tables


def test_every_row_is_a_point_or_a_reject(spark):
    rows = [("2020年1月", "1.5", 1), ("soon", "2", 2), (None, "3", 3), ("2020-02", "much", 4), ("2020-03", None, 5), ("2020-04-09", "4", 6), ("2020Q3", "inf", 7), ("2021", "6", 8), (" 2020/5 ", "nan", 9), ("2020-06", "7", 10)]
    df = spark.createDataFrame(rows, "month string, load string, id int")
    choice = tables.choose_columns(df)
    assert choice == ("month", "load", 10)
    series, rejects = tables.read_series(df, "plain", choice, "kwh")
    points = {(str(r.period), r.value) for r in series.collect()}
    told = {r.reason: (r.n, r.example) for r in rejects.collect()}
    assert len(points) + sum(n for n, _ in told.values()) == 10
    assert {("2020-04-09", 4.0), ("2021-01-01", 6.0), ("2020-06-01", 7.0)} <= points
    assert told["value unreadable"] == (2, "inf") and told["period missing"] == (1, None) and told["value missing"][0] == 2


def test_tables_that_cannot_be_read(spark):
    flat = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0)], "word string, load double")
    same = spark.createDataFrame([("2020-01", 1.0), ("2020-02", 1.0), ("2020-03", 1.0)], "month string, load double")
    nothing = spark.createDataFrame([], "month string, load double")
    series, rejects = tables.auto_series({"flat": flat, "same": same, "nothing": nothing})
    assert series.count() == 0
    assert {(r.source, r.reason, r.n) for r in rejects.collect()} == {("flat", "no period column", 3), ("same", "no value column", 3)}


def test_choice_prefers_names_then_rates(spark):
    df = spark.createDataFrame([(f"2020-0{i}", f"2019-0{i}-05", float(i), i * 10.0, 3.0 * i) for i in range(1, 7)], "x string, `Date` string, ytd_kwh double, kwh_month double, rate double")
    assert tables.choose_columns(df)[:2] == ("Date", "kwh_month")
    assert tables.choose_columns(df.drop("Date"))[0] == "x"


def test_text_files_come_back(spark, tmp_path):
    rows = [("a", "one\n\ntwo"), ("b/c d", "é"), ("empty", ""), ("none", None)]
    uri = f"file://{tmp_path}"
    documents.write_documents(spark.createDataFrame(rows, "title string, text string"), f"{uri}/deep", "title", "text").collect()
    (tmp_path / "notes.csv").write_text("left alone")
    (tmp_path / "more.md").write_text("# more")
    got = {r.source: (r.doc_id, r.text or "") for r in documents.read_documents(spark, uri, "region").collect()}
    assert got["a.txt"] == ("region:a", "one\n\ntwo") and got["more.md"] == ("region:more", "# more") and "notes.csv" not in got
    assert sorted(t for _, t in got.values()) == ["# more", "one\n\ntwo", "é"]


def test_text_files_are_listed_by_tasks_and_read_as_by_spark(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    for i in range(300):
        (tmp_path / "deep" / "er" / f"n{i}.txt").write_text(f"text {i}")
    (tmp_path / "deep" / "b%2Fc%20d.txt").write_bytes(b"\xff\xe9 raw\r\n")
    (tmp_path / "deep" / "a b.c!'()*,;$&+=@~#[]^.md").write_text("blank")
    for name in ("_no.txt", ".no.txt", "_hidden/no.txt", "no.TXT", "no.txt.gz"):
        (tmp_path / name).write_text("no")
    (tmp_path / "empty.txt").write_text("")
    found = documents.read_documents(spark, f"file://{tmp_path}")
    # a path without a scheme is left to Spark's reader
    assert sorted(found.collect()) == sorted(documents.read_documents(spark, str(tmp_path)).collect()) and found.count() == 302
    # no list of all files in the driver, no task for every few of them
    assert found.inputFiles() == [] and found.rdd.getNumPartitions() == 4
