"""The pipeline's stages: each keeps the documents' columns, takes effect, and agrees with brute force on a small corpus."""

from pyspark.sql import functions as F

import corpus_pipeline
from tidelattice.llm import decontam

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None), (10**6 + 1, "12 34"), (10**6 + 2, "")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    first = docs
    items = [(str(r["item_id"]), r["text"].encode()) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    windows = {tuple(w[j : j + 13]) for w in (decontam.words(t) for _, t in items) for j in range(max(1, len(w) - 12))}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, D)
        path = f"file://{tmp_path}/{k}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == first.columns
        ids = {r[0] for r in out.select("doc_id").collect()}
        before = {r[0] for r in docs.select("doc_id").collect()}
        assert ids <= before
        if name == "language":
            assert before - ids >= {10**6, 10**6 + 1, 10**6 + 2} and len(before - ids) < 10
        if name == "near_duplicates":
            texts = {r["doc_id"]: r["text"].lower().split() for r in docs.collect()}
            sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in texts.items()}
            kept = sorted(ids)
            for a in range(len(kept)):
                for b in kept[:a]:
                    x, y = sets[kept[a]], sets[b]
                    assert 100 * len(x & y) < 80 * len(x | y)
        if name == "decontaminate":
            for r in out.collect():
                w = decontam.words(r["text"].encode())
                assert not any(tuple(w[j : j + 13]) in windows for j in range(len(w) - 12))
                assert r["n_chars"] is None or r["n_chars"] == len(r["text"])
        docs = out
    sizes = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and docs.select(F.countDistinct("doc_id")).first()[0] == docs.count()


NEW = ("lang_pred", "lang_score", "__topic", "__tokens", "__row", "__cut", "__sampled", "__own", "row", "shard")


def test_stages_on_an_empty_table_with_clashing_names(spark):
    empty = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for c in NEW:
        empty = empty.withColumn(c, F.lit("mine"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, empty, D)
        assert out.count() == 0 and (k == len(corpus_pipeline.STAGES) - 1 or out.columns == empty.columns)


def test_stages_keep_other_columns_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").filter("text is not null")
    for c in NEW:
        docs = docs.withColumn(c, F.concat(F.lit("mine"), F.col("doc_id").cast("string")))
    docs = docs.unionByName(docs.filter("doc_id % 10 = 0"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, D)
        docs = spark.createDataFrame(docs.toArrow(), docs.schema)
        kept = [c for c in NEW if c in docs.columns and not (name == "shard" and c == "shard")]
        assert len(kept) >= len(NEW) - 1 and docs.filter(F.col("lang_pred") != F.concat(F.lit("mine"), F.col("doc_id").cast("string"))).isEmpty()
        counts = docs.groupBy("doc_id").count()
        assert counts.filter("(doc_id % 10 = 0) != (count = 2)").isEmpty()
    assert "text" in docs.columns and docs.filter("text is null").isEmpty() and docs.count() > 0


def test_run_leaves_only_what_its_result_reads(spark):
    from tidelattice.llm import store

    start = store.written()
    out = corpus_pipeline.run(spark, D)
    left = [p for _, p in store._written[start:] if p]
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "text", "lang", "source", "shard", "slot"}
    assert all(p.split("/")[-1].startswith(("shard-", "pipeline-mix-")) for p in left)


def test_a_task_of_decontamination_has_one_python_worker(spark):
    """Two operators in one stage are two workers a core, which an executor then keeps, with the texts between them in the JVM once more."""
    plan = corpus_pipeline.decontaminate(spark, spark.read.parquet(f"{D}/documents.parquet"), D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_sharding_starts_no_workers_for_rows_of_a_list(spark, monkeypatch):
    """They would be of another kind, with a daemon of their own that an executor keeps."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *_, **__: 1 / 0)
    out = corpus_pipeline.shard(spark, spark.read.parquet(f"{D}/documents.parquet"), D)
    assert out.count() > 0
