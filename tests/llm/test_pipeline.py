import corpus_pipeline

from tessera.llm import language, lines, minhash, quality


def test_stages_take_effect(spark, docs, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "line_dedup", "near_dedup", "packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, "").collect(), docs.schema)
        assert at.columns == docs.columns, name
    left = {r.doc_id for r in at.collect()}
    # without words, a letter or enough of them; copies and near copies of 4
    assert left == {0, 3, 4, 9, 10, None, 9007199254740993}
    packed = corpus_pipeline.packing(spark, at, "").collect()
    assert {r.doc_id for r in packed} == left
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_run_is_the_stages_in_order(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    kept = minhash.representatives(lines.clean(quality.clean(corpus_pipeline.language_id(spark, docs, ""))))
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in kept.collect()}
    assert language.UNDETERMINED == "und"
