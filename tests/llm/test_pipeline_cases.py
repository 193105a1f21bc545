"""Every stage on odd documents: nulls, empty and long texts, repeated rows, names that clash, and an empty table."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string, n_lines int, size string, id bigint, root string, key bigint"


def test_stages_take_odd_documents(spark):
    good = " ".join(f"word{i % 97} of number{i % 89} and thing{i % 83}" for i in range(60))
    other = " ".join(f"other{i % 71} text{i % 67} here{i % 61}" for i in range(80))
    long = " ".join(f"long{i % 977} line{i % 641}" for i in range(9000))
    rows = [(1, good), (2, good), (3, None), (4, ""), (5, long), (None, other), (6, other), (6, other), (7, "  \n "), (8, good + " more")]
    full = [(i, t, None if i == 1 else "en", None if i == 2 else "s", len(t or ""), "x", 7, "y", 9, "z", 5) for i, t in rows]
    docs = spark.createDataFrame(full, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [d for _, d in out.dtypes] == [d for _, d in docs.dtypes], name
        got = out.collect()
        assert all((r["a.b"], r.n_lines, r.size, r.id, r.root, r.key) == ("x", 7, "y", 9, "z", 5) for r in got), name
        left = sorted((r.doc_id or 0) for r in got)
        if name == "quality rules":
            assert not {3, 4, 7} & set(left)
        elif name == "MinHash near-dedup":
            assert 1 in left and not {2, 8} & set(left) and left.count(6) == 2 and left.count(0) == 1
        else:
            assert set(left) >= {1, 2, 5, 6, 8, 0}, name
        assert stage(spark, docs.limit(0), SF).collect() == []
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert ids.count() == len(rows) and {r.doc_id: r.n_tokens for r in ids.collect()}[4] == 0
