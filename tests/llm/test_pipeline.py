import corpus_pipeline as cp
from test_jaccard import brute as groups
from test_packing import sound
from test_suffix import brute as repeats


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    step = cp.ordinary(spark, docs, sf).cache()
    left = {r["doc_id"] for r in step.collect()}
    gone = {r["doc_id"] for r in docs.collect()} - left
    known = [toxic[i] for i in gone if i in toxic]
    assert step.columns == names and known and sum(known) >= 0.8 * len(known)
    rows = [(r["doc_id"], r["text"]) for r in step.collect()]
    step = cp.distinct(spark, step, sf).cache()
    assert step.columns == names and {r["doc_id"] for r in step.collect()} == {c for _, c in groups(rows, 5, 80).values()}
    rows = [(r["doc_id"], r["text"]) for r in step.collect()]
    want = repeats(rows, 50)
    step = cp.unrepeated(spark, step, sf).cache()
    assert step.columns == names and all(len(r["text"].encode()) == want[r["doc_id"]][0] - want[r["doc_id"]][1] or want[r["doc_id"]][1] for r in step.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in step.collect())
    rows = [(r["doc_id"], r["text"]) for r in step.collect()]
    sound(rows, cp.packed(spark, step, sf).collect(), 1024)


def test_odd_rows(spark, documents, sf):
    rows = documents([(1, None), (1, None), (None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (2, ""), (4, "a b c d e f g")]).withColumnRenamed("n", "n_chars")
    out = cp.distinct(spark, rows, sf)
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 0, 1, 2, 3]
    for _, stage in cp.STAGES:
        assert stage(spark, documents([]).withColumnRenamed("n", "n_chars"), sf).count() == 0
    assert cp.unrepeated(spark, rows, sf).count() == 7


def test_columns_of_any_name_stay(spark, documents, sf, tmp_path):
    docs = documents([(1, "a good day"), (2, None), (None, ""), (2, None), (4, "x " * 30000)]).withColumnRenamed("n", "n_chars").selectExpr("*", "-7.0D as score", "-8.0D as toxicity_score", "-9.0D as SCORE_")
    out = cp.ordinary(spark, docs, sf)
    assert out.columns == docs.columns
    assert {(r["score"], r["toxicity_score"], r["SCORE_"]) for r in out.collect()} == {(-7.0, -8.0, -9.0)}
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.ordinary(spark, docs, str(tmp_path)).count() == 5


def test_packing_of_odd_rows(spark, documents, sf):
    rows = documents([(1, None), (1, None), (None, "a b c"), (3, ""), (4, "word " * 3000)]).withColumnRenamed("n", "n_chars")
    got = cp.packed(spark, rows, sf).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 2 and sum(r["length"] for r in got if r["doc_id"] == 3) == 1
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 4 and all(r["length"] <= 1024 for r in got)
