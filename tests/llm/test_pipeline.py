import corpus_pipeline
from pyspark.sql import functions as F

from lakeloom.llm.toxicity import learn, score
from lakeloom.sources.tables import Tables

from .test_decontaminate import expected as contaminated
from .test_exact_dedup import expected as copies
from .test_minhash_dedup import brute as near

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_stages_like_brute_force(spark):
    """Each stage, on what the stages before it keep, against a plain rebuild of its decision."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = learn(docs, Tables(spark, SF).labels)
    toxic = {r["doc_id"] for r in score(docs, model).filter("score >= 0.5").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows_of(docs)
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        if name == "toxicity":
            want = [r for r in before if r[0] not in toxic]
        elif name == "exact_dedup":
            want = [r for r, x in zip(before, copies(before), strict=True) if x[3]]
        elif name == "near_dedup":
            kept = near(before, 5)
            want = [r for r in before if kept[r[0]][2]]
        elif name == "decontamination":
            found = contaminated(before, bench)
            want = [r for r in before if not found[r[0]][3]]
        assert rows_of(after) == want, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    final = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in final.select("doc_id").distinct().collect()} == {r[0] for r in rows_of(docs)}
    total = final.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert total.filter("n <> end or n > 2048").isEmpty()


def test_stages_take_odd_rows(spark, docs):
    table = docs((None, None), (1, ""), (1, ""), (2, "a b"), (3, None))
    for rows in (table, table.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, SF).columns == rows.columns
        corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect()
