import corpus_pipeline


def test_stages_in_order(spark, tmp_path):
    clean = [(i, " ".join(f"word{(i * 37 + k * k) % 999}" for k in range(80)), "en", "s", 0) for i in range(20)]
    planted = [(100, clean[3][1] + " extra", "en", "s", 0), (101, "you pathetic worthless idiot trash scum", "en", "s", 0), (102, "prefix " + " ".join(f"bench{k}" for k in range(14)), "en", "s", 0), (103, "mail me at someone@mail.example.com today", "en", "s", 0), (104, None, None, None, None)]
    spark.createDataFrame(clean + planted, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == source.columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    whole = set(range(20)) | {100, 102, 103, 104}
    assert set(seen["toxicity"]) == whole
    assert set(seen["near-duplicates"]) == whole - {100}
    assert set(seen["decontamination"]) == set(seen["pii"]) == whole - {100, 102}
    assert seen["pii"][103] == "mail me at [EMAIL] today" and seen["pii"][104] is None and seen["pii"][5] == clean[5][1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == whole - {100, 102}


def test_decisions_hold_for_rows_not_ids(spark, tmp_path):
    """Null, repeated and negative ids: each row stands or falls by its own text."""
    bench = " ".join(f"bench{k}" for k in range(12))
    a, b, c = (" ".join(f"{w}{k}" for k in range(60)) for w in "abc")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, row_number int"
    docs = spark.createDataFrame([(None, a, 1), (None, bench, 2), (7, b, 3), (7, bench, 4), (-1, bench, 5)], schema)
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and {r["row_number"] for r in clean.collect()} == {1, 3}
    docs = spark.createDataFrame([(None, a, 1), (None, a, 2), (None, b, 3), (7, b + " x", 4), (7, c, 5), (7, c, 6), (7, a + " y", 7), (3, None, 8), (None, None, 9)], schema)
    kept = [(r["doc_id"], (r["text"] or "")[:1]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(7, "a"), (7, "b"), (7, "c"), (3, ""), (None, "")], key=str)
