from pyspark.sql import functions as F

from corvane.operators import records
from corvane.sources import store
from corvane.streaming import reindex

RECORD = """---
id: elsewhere
namespace: not/this
kind: rule
modality: shall
abstract: true
status: active
tags:
    - auth
    - 'it''s'
provenance:
    type: code-derived
    file: a.go
    line_range:
        start: 3
        end: 9
created_at: 2024-05-01T10:00:00Z
relationships:
    - to: auth/other
      type: refines
      note: first
    - to: auth/other
      type: refines
      note: "second: last"
      unconfirmed: true
---

The body.

---

Still the body.
"""


def make(root, files):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def test_reading(spark, tmp_path):
    root = make(tmp_path / "statements", {
        "auth/deep/token.md": RECORD,
        "auth/no.rejected.md": "---\nrejected_at: 2024-05-01T10:00:00Z\nsee_instead: auth/deep/token\n---\n\nNot this.\n",
        "auth/_rejected.md": "---\nid: one\n---\n\nFirst.\n<!-- entry -->\n---\nid: two\n---\n\nSecond.\n",
    })
    s, e = store.statements(spark, root)
    r = s.first()
    assert s.count() == 1 and (r.full_id, r.namespace, r.id) == ("auth/deep/token", "auth/deep", "token")
    assert r.modality is None and r.abstract and r.tags == ["auth", "it's"] and (r.line_start, r.line_end) == (3, 9)
    assert r.body == "The body.\n\n---\n\nStill the body." and r.created_at.year == 2024
    assert [(x.to_id, x.note, x.unconfirmed) for x in e.collect()] == [("auth/other", "second: last", False)]
    rej = {x.full_id: (x.body, x.see_instead) for x in store.rejections(spark, root).collect()}
    assert rej == {"auth/no": ("Not this.", "auth/deep/token"), "auth/one": ("First.", None), "auth/two": ("Second.", None)}


def test_writing_is_read_back(spark, tmp_path):
    root = make(tmp_path / "statements", {"auth/token.md": RECORD})
    s, _ = store.statements(spark, root)
    out = str(tmp_path / "copy")
    store.write_records(store.record_text(s), out)
    again, _ = store.statements(spark, out)
    assert [tuple(x) for x in again.collect()] == [tuple(x) for x in s.collect()]


def test_manifest_and_stream(spark, tmp_path):
    root = make(tmp_path / "statements", {"a/x.md": RECORD, "a/y.md": RECORD})
    old = spark.createDataFrame(store.manifest(spark, root).collect(), "file_path string, mtime_ns bigint, size bigint")
    make(tmp_path / "statements", {"a/y.md": RECORD + "more", "a/z.md": RECORD})
    (tmp_path / "statements/a/x.md").unlink()
    diff = records.manifest_diff(old, store.manifest(spark, root))
    assert {(r.file_path, r.change) for r in diff.collect()} == {("a/x.md", "removed"), ("a/y.md", "updated"), ("a/z.md", "added")}
    seen = []
    q = reindex.follow(reindex.new_files(spark, root), lambda df, _: seen.extend(r.body[:8] for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert seen == ["The body"] * 2


def test_verdicts_clearances_lines_batches(spark, tmp_path):
    v = make(tmp_path / "verdicts", {"1.md": "---\na: b/2\nb: a/1\nverdict: not_related\ndecided_at: 2024-01-01T00:00:00Z\n---\n\nbecause\n"})
    assert [(r.a, r.b, r.note) for r in store.verdicts(spark, v).collect()] == [("a/1", "b/2", "because")]
    c = make(tmp_path / "clear", {"1.md": "---\nid: a/1\nbody_hash: ff\n---\n\n"})
    assert [(r.id, r.body_hash) for r in store.clearances(spark, c).collect()] == [("a/1", "ff")]
    src = make(tmp_path / "src", {"m.go": "one\ntwo", "skip/n.go": "x", "bin": "a\x00b"})
    assert {(r.file, r.line, r.text) for r in store.source_lines(spark, src, ("skip",)).collect()} == {("m.go", 1, "one"), ("m.go", 2, "two")}
    j = make(tmp_path / "ops", {"b.jsonl": '# note\n\n{"op":"link","from":"a","to":"b","type":"refines"}\n{"op":"add"}\n{'})
    got = records.batch(store.json_lines(spark, j))
    assert {(r.line_no, r.problem) for r in got.collect()} == {(3, None), (4, "missing namespace,id,kind,body"), (5, "malformed")}
    assert not records.batch_summary(got).first().applies
    assert store.as_json(got.filter("line_no = 3")).first().value == '{"line_no":3,"op":"link"}'
    store.write_table(got, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter(F.col("problem").isNotNull()).count() == 2
