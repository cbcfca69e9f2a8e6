from glanage.streaming import incremental as inc


def test_batches_add_up_and_documents_count_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    for i, rows in enumerate(([(1, "chat noir"), (2, "chat")], [(2, "autre"), (3, "noir noir")])):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        inc.index_stream(inc.stream_documents(spark, src), out, check).awaitTermination()
    got = {(r["term"], r["doc_id"], r["tf"]) for r in inc.latest(spark, out).collect()}
    assert got == {("chat", 1, 1), ("noir", 1, 1), ("chat", 2, 1), ("noir", 3, 2)}


def test_term_counts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    assert {(r["term"], r["n"]) for r in inc.term_counts(docs).collect()} == {("a", 1), ("b", 2)}
