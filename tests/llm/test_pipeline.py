import corpus_pipeline

from fenceline.llm import jaccard, queries, repeats

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs
    by_stage = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        by_stage[name] = docs
        if name != "packing":
            assert docs.columns == given.columns
    assert by_stage["quality_rules"].count() < given.count()
    assert jaccard.groups(by_stage["ngram_jaccard"]).where("component_id <> doc_id").count() == 0
    assert repeats.removals(by_stage["suffix_repeats"]).agg({"n_removed": "sum"}).first()[0] <= 200
    total = by_stage["packing"].groupBy("sequence_id").sum("length").toDF("s", "n")
    assert total.where("n > 1024").count() == 0
    assert by_stage["packing"].select("doc_id").distinct().count() == by_stage["mixing"].select("doc_id").distinct().count()


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_nothing_is_left_but_the_result(spark, tmp_path):
    import os

    from fenceline.sources import shared

    docs = tmp_path / "documents.parquet"
    spark.read.parquet(f"{SF}/documents.parquet").limit(60).write.parquet(str(docs))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    folder = os.path.dirname(shared.new_path(spark, "x"))
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and next(iter(left)).startswith("packing-")
