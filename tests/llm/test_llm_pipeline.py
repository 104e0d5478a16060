"""The pipeline's stages on a small corpus, each against what it has to do with its own input."""


import corpus_pipeline
from factloom.llm import secret_scan
from test_llm_operators import labelled_corpus


def test_stages(spark, tmp_path):
    docs, labels = labelled_corpus(spark)
    secret = 'password = "abcdefghijklmnopqrst"'
    text = docs.where("doc_id = 1").first()["text"]
    more = spark.createDataFrame([(800, f"{text} {secret} end", "en", "s"), (801, text, "en", "s")], docs.schema)
    docs = docs.unionByName(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mixing", "packing"]
    now, rows = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = now.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        rows[name] = now.collect()
        if i < 4:
            assert now.columns == columns
    low = {r["doc_id"] for r in labels.collect() if r["quality"] == 0}
    kept = {r["doc_id"] for r in rows["quality"]}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["doc_id"] is not None}
    assert len(kept & low) < 0.05 * len(low) and len(good - kept) < 0.03 * len(good)
    assert 801 not in {r["doc_id"] for r in rows["near_dedup"]}
    assert not any(secret_scan.base_spans(r["text"] or "") for r in rows["secrets"])
    assert {r["doc_id"] for r in rows["secrets"]} == {r["doc_id"] for r in rows["near_dedup"]}
    assert {r["doc_id"] for r in rows["packing"]} == {r["doc_id"] for r in rows["mixing"]}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == len(rows["packing"])


def test_stages_on_no_rows_and_clashing_columns(spark, tmp_path):
    docs, labels = labelled_corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names = ("kept", "rate", "copies", "spans", "score", "row", "comp")
    wide = docs.withColumns({c: docs["doc_id"] for c in names})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, wide, str(tmp_path))
        if name != "packing":
            assert got.columns == wide.columns
            assert all(r["rate"] == r["doc_id"] and r["spans"] == r["doc_id"] for r in got.where("doc_id is not null").collect())
        assert got.count() > 0 and stage(spark, wide.limit(0), str(tmp_path)).count() == 0
