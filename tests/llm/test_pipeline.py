import re

import corpus_pipeline
from corvane.llm import decontaminate, line_dedup, minhash, quality


def test_stages_compose(spark):
    """The pipeline's rows are those of the operators' own reports, one after the other."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    step = docs.join(quality.report(docs).filter("kept").select("doc_id"), "doc_id", "left_semi")
    lines = {r.doc_id: r.text for r in line_dedup.dedup_lines(step).collect()}
    step = spark.createDataFrame([(i, t) for i, t in lines.items()], "doc_id bigint, text string")
    near = {r.doc_id for r in minhash.report(step, minhash.Rule(5, 80)).filter("kept").collect()}
    step = step.filter(step.doc_id.isin(list(near)))
    leaks = {r.doc_id for r in decontaminate.matches(step, bench).collect()}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == near - leaks
    assert all(r.n_tokens > 0 and re.fullmatch("[0-9a-f]{64}", r.decoded_sha256) for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
