from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_in_order_and_effective(spark, tmp_path):
    docs = [(k, f"the {k} and of that this with number {k} of the {k * 7} things that {k * 3} is here in the {k * 11} place", "en", "s", 10) for k in range(60)]
    copy = docs[3][1]
    item = "once upon a time there was a benchmark item that nobody should have seen before today"
    docs += [(100, copy, "en", "s", 1), (101, "12 34", "en", "s", 1), (102, None, "en", "s", 1), (103, "intro words go here " + item + " and so on", "en", "s", 1), (104, copy, "en", "s", 1)]
    docs.append(docs[5])  # a repeated row
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    extra = ("lang_pred", "score", "held_out", "decided_id", "uid", "kept")  # names that the operators use too
    rows.select("*", *(F.lit("x").alias(c) for c in extra)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_identification", "near_duplicates", "decontamination", "packing"]
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
        df.write.parquet(str(tmp_path / f"stage{len(kept)}"))
        df = spark.read.parquet(str(tmp_path / f"stage{len(kept)}"))
        kept.append(sorted(r["doc_id"] for r in df.collect()))
    assert {101, 102}.isdisjoint(kept[0]) and len(kept[0]) == len(docs) - 2
    assert kept[1] == [k for k in range(60)] + [103]
    assert kept[2] == list(range(60))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(range(60))


def test_near_duplicates_go_by_row(spark, tmp_path):
    """Null ids and several texts under one id leave one row of each group."""
    texts = [" ".join(f"{stem}{k}" for k in range(60)) for stem in "abcd"]
    near = [t + " more" for t in texts]
    docs = [(None, texts[0]), (7, near[0]), (None, texts[0])]  # a null copy of a document with an id
    docs += [(None, texts[1]), (None, near[1]), (None, texts[1])]  # null ids only
    docs += [(5, texts[2]), (5, near[2]), (5, texts[2]), (9, texts[3]), (5, near[3]), (4, texts[3])]  # one id in two groups
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row_id", F.lit("x")).repartition(3)
    got = corpus_pipeline.remove_near_duplicates(spark, df, str(tmp_path))
    assert got.columns == ["doc_id", "text", "row_id"]
    got = [(r["doc_id"], r["text"].split()[0]) for r in got.collect()]
    assert sorted(got, key=str) == [(4, "d0"), (5, "c0"), (7, "a0"), (None, "b0")]


def test_empty_tables_nulls_and_a_long_text(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    words = "the and of that this with number things is here in place".split()
    rows = [(k, " ".join(f"{w}{k}" for w in words), "en", "s", 1) for k in range(20)] + [(None, long, None, None, None), (None, None, None, None, None), (50, long + " end", "en", "s", 1)]
    for name, docs, items in (("a", [], []), ("b", rows, []), ("c", [], [(1, "an item of five words")]), ("d", [(1, None, "en", "s", 1), (2, "", None, "s", 1)], [(1, None)])):
        folder = tmp_path / name
        spark.createDataFrame(docs, columns).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        if name == "b":
            assert {r["doc_id"] for r in got} == {*range(20), 50}
            assert sum(r["length"] for r in got if r["doc_id"] == 50) == {r["doc_tokens"] for r in got if r["doc_id"] == 50}.pop()
        else:
            assert got == []
