"""Search words that an index does not hold, and signs in terms."""

from pyspark.sql import functions as F
from rows import collected

from runledger.operators import search as S


def _index(spark):
    rows = [("1", "failed to connect to database"), ("2", "all fine c++ (x)"), ("3", "connect failed")]
    return S.build_text_index(spark.createDataFrame(rows, "k string, t string"), "k", "t")


def _ids(found):
    return [r["id"] for r in found.orderBy("id").collect()]


def test_stop_words_are_not_asked_for(spark):
    index = _index(spark)
    assert _ids(S.search_match(index, all_of=["failed", "to", "connect"])) == ["1", "3"]
    assert _ids(S.search_match(index, phrases=[["failed", "to", "connect"]])) == ["1"]
    assert _ids(S.search_match(index, phrases=[["failed", "connect"]])) == []
    assert _ids(S.search_match(index, all_of=["to"])) == []
    queries = spark.createDataFrame([("q", "failed"), ("q", "to"), ("q", "database")], "query_id string, term string")
    assert collected(S.search_batch(index, queries), "query_id", "id") == [("q", "1")]


def test_none_of_alone(spark):
    index = _index(spark)
    assert _ids(S.search_match(index, none_of=["database"])) == ["2", "3"]
    assert _ids(S.search_match(index, all_of=["the"], none_of=["connect"])) == ["2"]


def test_signs_in_terms(spark):
    text = spark.createDataFrame([("use C++ now (x|y)",)], "t string")
    assert text.select(S.mark("t", ["c++", "(x|y)"]).alias("m")).first()["m"] == "use <mark>C++</mark> now <mark>(x|y)</mark>"


def _files_read(df):
    run = df._jdf.queryExecution()
    run.toRdd().count()
    return run.executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_stored_index_reads_files_of_its_words(spark, tmp_path):
    rows = [(str(i), f"common word{i % 50} only{i}") for i in range(400)]
    index = S.build_text_index(spark.createDataFrame(rows, "k string, t string"), "k", "t")
    path = str(tmp_path / "index")
    for batch in (0, 1, 1):  # the last one again
        S.write_search_index(index.where(F.pmod(F.col("id").cast("int"), F.lit(2)) == batch), path, batch, buckets=64 if batch else 16)
    whole = S.read_search_index(spark, path, index.schema)
    assert whole.exceptAll(index).isEmpty() and index.exceptAll(whole).isEmpty()
    part = S.read_search_index(spark, path, index.schema, ["Word7", "only57"])
    assert _files_read(part) <= 4 < _files_read(whole) // 4
    assert _ids(S.search_match(part, all_of=["word7"], none_of=["only57"])) == sorted(str(i) for i in range(7, 400, 50) if i != 57)
    assert S.read_search_index(spark, path, index.schema, []).isEmpty()


def test_words_of_other_scripts(spark):
    rows = spark.createDataFrame([("1", "Größe мир 東京 tool")], "k string, t string")
    assert {r["term"] for r in S.build_text_index(rows, "k", "t", S.ANY_WORD).collect()} == {"größe", "мир", "東京", "tool"}
    assert {r["term"] for r in S.build_text_index(rows, "k", "t").collect()} == {"gr", "e", "tool"}
