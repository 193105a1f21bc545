"""What steps before have left in the driver is given back."""

import re

import corpus_pipeline
from corvane.llm import scratch

SF = "/root/testdata/sf0.001"


def test_let_go_gives_native_memory_back(spark):
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.management.ManagementFactory.getRuntimeMXBean().getPid()

    def held() -> int:
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) // 1024

    scratch.let_go(spark)
    made = [jvm.java.util.zip.Deflater() for _ in range(2000)]
    full = held()
    for x in made[:-1]:  # the last one stays: freed memory below it does not go by itself
        x.end()
    scratch.let_go(spark)
    assert held() < full - 80


def test_stages_begin_by_letting_go(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "let_go", calls.append)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF)
        assert len(calls) == k + 1, name
