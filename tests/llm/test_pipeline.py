import corpus_pipeline as P


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, small)
        if k < len(P.STAGES) - 1:
            docs = docs.checkpoint()
            n = docs.count()
            assert docs.columns == columns and 0 < n <= seen, name
            seen = n
    assert docs.select("doc_id").distinct().count() == seen
    assert P.run(spark, small).count() == docs.count()


def test_stages_take_odd_rows_and_empty_tables(spark, documents, small):
    """Each stage alone, on nulls, repeats, blanks, a long text and clashing columns, and on nothing."""
    rows, texts = documents.count(), {r.doc_id: r.text for r in documents.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        last = k == len(P.STAGES) - 1
        out = stage(spark, documents, small)
        assert last or out.columns == documents.columns, name
        got = out.select("doc_id").collect()
        kept = {r.doc_id for r in got}
        assert kept <= set(texts), name
        if name == "quality_rules":
            assert not kept & {5, 6, 7, 8}
        elif name == "simhash_near_dedup":
            assert {1, 2, 3} & kept == {1} and len({5, 6, 7} & kept) == 1 and 9 in kept
        elif last:
            assert kept == set(texts)
        else:
            assert len(got) == rows, name
        assert stage(spark, documents.limit(0), small).count() == 0, name


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
