"""The pipeline: each stage keeps the columns of documents and only loses what it should."""

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    before = docs.count()
    for name, step in pipeline.STAGES:
        out = step(spark, docs, SF).cache()
        after = out.count()
        if name != "sentencepiece":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert 0 < after <= before and (name != "line_dedup" or after == before)
            docs, before = out, after
    assert after == before and out.where("not round_trip").count() == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", "en", None, 0), (None, "the cat and the dog sat on the mat", None, "s", 1), (3, "the cat and the dog sat on the mat", "en", "s", 34)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for data in (docs, docs.limit(0)):
        for _, step in pipeline.STAGES:
            data = step(spark, data, SF)
        assert data.count() <= 2
