import corpus_pipeline
from weftlog.llm import scratch


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs, counts = docs.unionByName(docs.limit(5)), []
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.keep(stage(spark, docs, small), name)
        if name != "packing":
            assert after.columns == docs.columns
            assert after.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
            counts.append(after.count())
        docs = after
    assert counts[0] > 100 and counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    pieces = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r[1] <= 4096 for r in pieces)


def test_run_and_empty(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 100
    docs = spark.read.parquet(f"{small}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, small), name)
        assert docs.count() == 0
