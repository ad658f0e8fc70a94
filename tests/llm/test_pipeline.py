import corpus_pipeline
import __spark_entry__


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"] for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialise(stage(spark, docs, sf))
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= seen and (docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1)
        assert now == seen or i < 3  # mixing and sharding lose no document
        seen = now
    assert set(columns) <= set(docs.columns) and {"shard", "slot"} <= set(docs.columns)


def test_registry():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
