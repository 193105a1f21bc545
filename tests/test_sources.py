"""Front matter, ignore rules, the atomic sink and the snapshot stream."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import trace
from corvane.sources import front, ignore, sink, store
from corvane.streaming import snapshots
from tests.test_store import RECORD, make


@pytest.mark.parametrize(
    "text, want",
    [
        ("a: 1\nb: two # c\nc: 'it''s'\nd: \"x\\ny: # z\"\n", {"a": 1, "b": "two", "c": "it's", "d": "x\ny: # z"}),
        ('tags: ["a,b", c, \'d\']\nm: {x: 1, y: [a, b]}\n', {"tags": ["a,b", "c", "d"], "m": {"x": 1, "y": ["a", "b"]}}),
        ("note: |\n  one\n\n    two # no comment\n  # three\n\nb: >-\n  fold\n  me\n\n  para\nlast: x", {"note": "one\n\n  two # no comment\n# three\n", "b": "fold me\npara", "last": "x"}),
        ("r:\n- to: a/b\n  note: \"second: last\"\n- to: c\n", {"r": [{"to": "a/b", "note": "second: last"}, {"to": "c"}]}),
        ("active: true # now\nurl: http://x.y/z#frag\nn: ~\n# all\n\ne:\n", {"active": True, "url": "http://x.y/z#frag", "n": None, "e": None}),
        ("k: a long\n  text goes on\nz: -1\nf: [a,\n  b]\n", {"k": "a long text goes on", "z": -1, "f": ["a", "b"]}),
        ("t:\n  - a\n  - b: c\n    d:\n      e: 1.5\n  - [1, 2]\n  - 'q # r'\n", {"t": ["a", {"b": "c", "d": {"e": 1.5}}, [1, 2], "q # r"]}),
        ("x: |+\n  a\n\n\ny: |-\n  b\n\nz: |2\n    c\n", {"x": "a\n\n\n", "y": "b", "z": "  c\n"}),
        ("", {}),
    ],
)
def test_front_matter(text, want):
    assert front.parse(text) == want


@pytest.mark.parametrize("text", ["a: b: c\n", "x: [1, 2\n", "- a\n", "a: &x 1\n", "a: 1\na: 2\n", "a: 1\n  b: 2\n", "a: 'open\n", "\ta: 1\n", "only words\n", "a: {b: c\n"])
def test_bad_front_matter_is_an_error(text):
    with pytest.raises(front.FrontError):
        front.parse(text)


def test_bad_files_are_named(spark, tmp_path):
    root = make(tmp_path / "s", {"a/good.md": RECORD, "a/bad.md": "---\nkind: [rule\n---\n\nx\n"})
    with pytest.raises(Exception, match="a/bad.md"):
        store.statements(spark, root)[0].collect()


def test_ignore_rules(spark):
    """The last match wins, deeper files' after outer ones'; folders are pruned; anchors, stars, classes and escapes."""
    rules = ignore.compiled("# top\n*.log\n!keep.log\nbuild/\n/only-top.txt\ndoc/**/gen\na?c\n[x-z]*.tmp\n\\#hash\n**/deep/leaf\ntrail   \nvendor/*\n!vendor/own/\n")
    rules += ignore.compiled("!again.log\nsub/x.go\n*.md\n", "pkg")
    want = {
        "a.log": 1, "p/q/a.log": 1, "keep.log": 0, "p/keep.log": 0, "build/x.go": 1, "p/build/x.go": 1, "build": 0, "build/keep.log": 1, "only-top.txt": 1, "p/only-top.txt": 0,
        "doc/gen": 1, "doc/a/b/gen/x": 1, "p/doc/gen": 0, "abc": 1, "abbc": 0, "y1.tmp": 1, "w1.tmp": 0, "#hash": 1, "deep/leaf": 1, "p/q/deep/leaf": 1, "trail": 1, "vendor/lib/x.go": 1, "vendor/own/x.go": 0,
        "pkg/again.log": 0, "again.log": 1, "pkg/sub/x.go": 1, "pkg/p/sub/x.go": 0, "pkg/r.md": 1, "r.md": 0, "x.logs": 0,
    }
    df = spark.createDataFrame([(k,) for k in want], "p string").select("p", ignore.ignored(F.col("p"), rules).alias("i"))
    assert {r.p: int(r.i) for r in df.collect()} == want


def test_scan_leaves_out_ignored_and_generated(spark, tmp_path):
    """Labels in source and test count, those in dependencies, in the store and in generated documents do not."""
    root = make(tmp_path / "src", {
        ".gitignore": "node_modules/\n", "src/auth.go": "// decision: auth/plain\nfunc x() {}\n// decision: auth/expiry\n", "src/auth_test.go": "// decision: auth/plain\n", "node_modules/junk/v.go": "// decision: auth/vendored\n",
        "store/auth/x.md": "decision: auth/stored\n", "AGENTS.md": "decision: auth/example\n", "docs/AGENTS.md": "decision: auth/named\n", "new.go": "// decision: auth/fresh\n", "pkg/.gitignore": "gen.go\n", "pkg/gen.go": "// decision: auth/gen\n", "gen.go": "// decision: auth/kept\n",
    })
    refs = trace.scan(store.source_lines(spark, root, (*store.GENERATED, "store")))
    got = sorted((r.full_id, r.file, r.line) for r in refs.collect())
    assert got == [("auth/expiry", "src/auth.go", 3), ("auth/fresh", "new.go", 1), ("auth/kept", "gen.go", 1), ("auth/named", "docs/AGENTS.md", 1), ("auth/plain", "src/auth.go", 1), ("auth/plain", "src/auth_test.go", 1)]
    assert trace.scan(store.source_lines(spark, make(tmp_path / "none", {"main.go": "package main\n"}))).collect() == []


def held(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file()}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    """A task that fails after others wrote: the store is as it was; a good batch replaces, adds and removes."""
    root = tmp_path / "store"
    make(root, {"a/x.md": "old", "a/y.md": "stays", "a/z.md": "goes"})
    before = held(root)
    rows = [(f"b/r{i}.md", "new") for i in range(40)] + [("a/x.md", "new")]
    bad = spark.createDataFrame(rows, "file_path string, content string").repartition(6).withColumn("content", F.when(F.col("file_path") == "b/r7.md", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        store.write_records(bad, str(root))
    assert held(root) == before
    with pytest.raises(Exception, match="no place"):
        store.write_records(spark.createDataFrame([("../x.md", "c")], "file_path string, content string"), str(root))
    with pytest.raises(ValueError, match="twice"):
        store.write_records(spark.createDataFrame([("q.md", "c")] * 2, "file_path string, content string"), str(root))
    assert held(root) == before
    store.write_records(spark.createDataFrame([*rows, ("a/z.md", None), ("a/none.md", None)], "file_path string, content string").repartition(5), str(root))
    assert held(root) == dict(rows) | {"a/y.md": "stays"}


def test_a_listed_batch_is_finished_by_the_next_reader(tmp_path):
    """The writer is lost after the list, with one file moved already; without a list nothing is done."""
    root = tmp_path / "store"
    make(root, {"a/x.md": "old", "a/moved.md": "new", ".staging/b1/0-0/a/x.md": "new", f".staging/b1/1-0/a/gone.md{sink.REMOVED_NAME}": "", ".staging/b1/1-1/a/attempt.md": "not listed", ".staging/b1/commit.json": '["0-0", "1-0"]', "a/gone.md": "old", ".staging/b2/0-0/a/no.md": "half"})
    assert sink.recover(str(root)) == 1 and sink.recover(str(root)) == 0
    assert held(root) == {"a/x.md": "new", "a/moved.md": "new", ".staging/b2/0-0/a/no.md": "half"}


def test_snapshots_stream_edits_and_removals(spark, tmp_path):
    """Three snapshots: an edit keeps its vector, a removal drops it; two versions in one batch come to one change a file."""
    root, state = tmp_path / "statements", str(tmp_path / "state")
    make(root, {"a/x.md": RECORD, "a/y.md": RECORD})
    assert snapshots.take(spark, str(root), state) == 1 and snapshots.take(spark, str(root), state) == 1
    s = store.statements(spark, str(root))[0].limit(0)
    tables = {"s": spark.createDataFrame([], s.schema), "e": spark.createDataFrame([("statement", "a/x"), ("statement", "a/y")], "source_kind string, full_id string")}
    seen = []

    def apply(diff, _):
        seen.append({r.file_path: r.change for r in diff.collect()})
        new, vectors = snapshots.applied(spark, str(root), diff, tables["s"], tables["e"])
        tables["s"] = spark.createDataFrame(new.collect(), s.schema)
        tables["e"] = spark.createDataFrame(vectors.collect(), "source_kind string, full_id string")

    def run():
        snapshots.follow(spark, state, apply, str(tmp_path / "cp")).awaitTermination(60)

    run()
    assert seen == [{"a/x.md": "added", "a/y.md": "added"}] and tables["e"].count() == 2
    make(root, {"a/y.md": RECORD.replace("The body.", "Another body."), "a/z.md": RECORD})
    snapshots.take(spark, str(root), state)
    (root / "a/z.md").unlink()
    (root / "a/x.md").unlink()
    assert snapshots.take(spark, str(root), state) == 3
    run()
    merged = {k: v for d in seen[1:] for k, v in d.items()}
    assert merged == {"a/y.md": "updated", "a/x.md": "removed"} or (len(seen) == 3 and merged["a/z.md"] == "removed")
    assert {r.full_id: r.body.split(".")[0] for r in tables["s"].collect()} == {"a/y": "Another body"}
    assert [r.full_id for r in tables["e"].collect()] == ["a/y"]
    run()
    assert len(seen) <= 3


def test_many_parts_are_not_sent_to_all(spark, monkeypatch):
    """The keys of a large table take few bytes in their file, so Spark would have the driver hold them all."""
    from corvane.sources import adapters

    names = lambda: adapters.Corpus(spark, "/root/testdata/sf0.001").statements.select("full_id")
    few = names()
    monkeypatch.setattr(adapters, "SENT_ROWS", 10)
    many = names()
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(few.collect()) == sorted(many.collect())
