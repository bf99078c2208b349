from corpus_pipeline import STAGES, run
from tests.llm.cases import odd_documents, write_tables


def test_stages_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    before = docs.count()
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = docs.count()
        assert 0 < after <= before
        before = after
    assert run(spark, sf_dir).count() == before


def test_odd_tables(spark, tmp_path):
    bench = spark.createDataFrame([(1, "a b c"), (None, None)], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    for name, docs in (("full", odd_documents(spark)), ("empty", odd_documents(spark).limit(0))):
        path = write_tables(tmp_path / name, documents=docs, benchmark=bench, labels=labels)
        assert (run(spark, path).count() > 0) == (name == "full")
