import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import audit, diffcheck, fusion, graph, lexical, listing, models, records, trace, vectors
from corvane.plans import check

STATEMENT = "full_id string, id string, namespace string, kind string, modality string, abstract boolean, body string, status string, tags array<string>, source_file string, line_start int, line_end int"
EDGE = "from_id string, to_id string, type string, note string, via string, unconfirmed boolean"


def statements(spark, rows):
    out = []
    for full_id, body, *more in rows:
        o = {"status": "active", "modality": None, "abstract": False, "tags": [], "source": None, **(more[0] if more else {})}
        ns, _, slug = full_id.rpartition("/")
        out.append((full_id, slug, ns, "rule", o["modality"], o["abstract"], body, o["status"], o["tags"], o["source"], 1, 5))
    return spark.createDataFrame(out, STATEMENT)


def edges(spark, rows):
    return spark.createDataFrame([(a, b, t, None, None, False) for a, b, t in rows], EDGE)


def embeddings(spark, rows):
    return spark.createDataFrame([("statement", i, "m", len(v), [float(x) for x in v], "h") for i, v in rows], "source_kind string, full_id string, model string, dims int, vector array<float>, source_hash string")


def as_records(s, rejections=None):
    r = s.select(F.lit("statement").alias("source_kind"), "full_id", "namespace", "body", "status", "tags", F.lit(None).cast("string").alias("see_instead"))
    return r if rejections is None else r.unionByName(rejections)


def tables(spark, s, e=None, v=None):
    rec = as_records(s)
    from corvane.functions import text as T

    return check.Tables(rec, rec.select("source_kind", "full_id", F.explode(T.facets(F.col("body"))).alias("facet")), e if e is not None else edges(spark, []).limit(0), v)


def test_semantic_finds_what_words_do_not(spark):
    s = statements(spark, [("a/x", "tokens expire hourly"), ("a/y", "widgets are blue")])
    t = tables(spark, s, v=embeddings(spark, [("a/x", [1, 0]), ("a/y", [0, 1])]))
    got = check.hits(t, "widgets", vector=[1.0, 0.0], model="m").collect()
    assert {(r.full_id, r.match_kind) for r in got} == {("a/x", "semantic"), ("a/y", "lexical")}
    both = check.hits(t, "tokens widgets", vector=[1.0, 0.0], model="m").collect()
    assert (both[0].full_id, both[0].match_kind) == ("a/x", "both")
    with pytest.raises(ValueError, match="dimensions"):
        check.hits(t, "x", vector=[1.0], model="m")


def test_fusion_knows_positions_only(spark):
    lists = lambda scale: spark.createDataFrame([("statement", k, s * scale, "l") for k, s in (("a", 3.0), ("b", 2.0), ("c", 1.0))], "source_kind string, full_id string, score double, l string")
    got = [[(r.full_id, round(r.score, 9)) for r in fusion.fuse(fusion.ranked(lists(x), "l", "lexical", [F.desc("score"), "full_id"])).collect()] for x in (1.0, 1e6)]
    assert got[0] == got[1] and got[0][0] == ("a", round(1 / 61, 9))
    two = spark.createDataFrame([("statement", "a"), ("rejection", "a")], "source_kind string, full_id string")
    assert fusion.fuse(fusion.ranked(two, "l", "lexical", ["full_id"])).count() == 2


def test_saturated_words_are_dropped(spark):
    s = as_records(statements(spark, [(f"a/s{i}", f"every record shares words and unique{i}") for i in range(30)]))
    tok = lexical.tokenised(s)
    phrases = lexical.draft_phrases(spark, "shares words unique7")
    counts = lexical.corpus_counts(tok, phrases)["statement"]
    assert lexical.kept_fields(phrases, counts) == [2]
    assert lexical.kept_fields(phrases[:2], counts) == [0, 1]
    assert [r.full_id for r in lexical.bm25(tok, phrases, {"statement": counts}).collect()] == ["a/s7"]


def test_phrases_need_adjacency(spark):
    s = as_records(statements(spark, [("a/x", "auth session here"), ("a/y", "session then auth")]))
    tok = lexical.tokenised(s)
    phrases = lexical.draft_phrases(spark, "auth/session")
    assert phrases == [["auth", "session"]]
    assert [r.full_id for r in lexical.bm25(tok, phrases, lexical.corpus_counts(tok, phrases)).collect()] == ["a/x"]


def test_stems_meet(spark):
    t = tables(spark, statements(spark, [("a/x", "cancellation of orders"), ("a/y", "nothing alike")]))
    assert [r.full_id for r in check.hits(t, "cancellable").collect()] == ["a/x"]


def test_tags_narrow_words_only(spark):
    s = statements(spark, [("a/x", "tokens", {"tags": ["t"]}), ("a/y", "tokens")])
    t = tables(spark, s, v=embeddings(spark, [("a/y", [1, 0])]))
    assert {r.full_id for r in check.hits(t, "tokens", tags=["t"], vector=[1.0, 0.0], model="m").collect()} == {"a/x", "a/y"}
    assert {r.full_id for r in check.hits(t, "tokens", tags=["t"]).collect()} == {"a/x"}


def test_retired_are_not_found_and_proposals_challenge(spark):
    s = statements(spark, [("a/x", "tokens expire", {}), ("a/y", "tokens stay", {"status": "proposed"}), ("a/z", "tokens old", {"status": "superseded"})])
    t = tables(spark, s, edges(spark, [("a/y", "a/x", "conflicts_with")]))
    got = {r.full_id: r for r in check.check(t, "tokens").collect()}
    assert set(got) == {"a/x", "a/y"} and got["a/x"].challenged and not got["a/y"].challenged


def test_duplicate_gate(spark):
    body = "sessions expire after thirty minutes idle unless renewed by the owner"
    t = tables(spark, statements(spark, [("a/x", body), ("a/y", "colours of widgets")]))
    assert [r.full_id for r in check.duplicates_of(t, body).collect()] == ["a/x"]
    assert check.duplicates_of(t, "sessions").count() == 0


def test_related_corpora_are_not_fused(spark):
    t = tables(spark, statements(spark, [("a/x", "tokens expire")]))
    got = check.related({"one": t, "two": t}, "tokens").collect()
    assert {r.full_id for r in got} == {"one:a/x", "two:a/x"}
    with pytest.raises(ValueError, match="vector"):
        check.related({"one": t}, "tokens", vector=[1.0])


def test_expansion_order_and_scope(spark):
    s = statements(spark, [("a/seed", "b"), ("a/p", "b"), ("a/q", "b"), ("a/gone", "b", {"status": "deprecated"}), ("a/m", "b")])
    rej = spark.createDataFrame([("rejection", "r/1", "r", "b", None, [], "a/seed")], as_records(s).schema)
    e = edges(spark, [("a/seed", "a/p", "refines"), ("a/q", "a/seed", "conflicts_with"), ("a/seed", "a/gone", "conflicts_with"), ("a/seed", "a/m", "moved_to")])
    page = spark.createDataFrame([("statement", "a/seed", 1)], "source_kind string, full_id string, pos int")
    got = [(r.full_id, r.via_type) for r in graph.expand(page, e, as_records(s, rej)).collect()]
    assert got == [("a/m", "moved_to"), ("a/q", "conflicts_with"), ("r/1", "see_instead"), ("a/p", "refines")]
    assert [r.full_id for r in graph.expand(page, e, as_records(s, rej), limit=1).collect()] == ["a/m"]


def circle(spark, degrees):
    ids = [f"a/s{i}" for i in range(len(degrees))]
    return statements(spark, [(i, "b") for i in ids]), embeddings(spark, [(i, (math.cos(math.radians(d)), math.sin(math.radians(d)))) for i, d in zip(ids, degrees)])


def run_audit(spark, s, v, judged=(), k=1):
    verdicts = spark.createDataFrame([(*sorted(p), "not_related") for p in judged], "a string, b string, verdict string")
    facets = tables(spark, s).facets
    q, p = audit.audit(s, facets, v, edges(spark, []), verdicts, "m", neighbours=k)
    return [(r.a, r.b) for r in audit.page(q, 0).collect()], p.first()


def test_the_queue_drains(spark):
    s, v = circle(spark, [0, 20, 40, 90])
    pairs, progress = run_audit(spark, s, v)
    judged, swept = [], progress.swept
    while pairs:
        judged.append(pairs[0])
        left, progress = run_audit(spark, s, v, judged)
        assert set(left) == set(pairs) - {pairs[0]} and progress.swept >= swept
        pairs, swept = left, progress.swept
    assert progress.remaining == 0 and progress.swept == progress.statements == 4
    assert len(run_audit(spark, s, v, judged, k=2)[0]) > 0


def test_neighbours_grow_in_proportion(spark):
    rng = np.random.default_rng(0)
    v = embeddings(spark, [(f"a/{i}", [1 + x for x in rng.normal(0, 0.01, 4)]) for i in range(40)])
    near = vectors.nearest(v, 1, block=7)
    assert near.count() == 40 and audit.knn_pairs(near, 1).count() <= 40


def test_blocks_equal_lambdas(spark):
    rng = np.random.default_rng(1)
    v = embeddings(spark, [(f"a/{i}", rng.normal(size=5)) for i in range(30)])
    near = vectors.nearest(v, 29, block=8)
    both = vectors.pair_similarity(near.select("a", "b", F.col("sim").alias("s")), v)
    assert both.filter("abs(s - sim) > 1e-9").count() == 0 and both.count() == 870


def test_identifiers_rank_over_likeness_and_hubs_make_no_pairs(spark):
    s = statements(spark, [("a/p", "the user_ttl"), ("a/q", "x user_ttl"), ("a/r", "same"), ("a/s", "same")] + [(f"h/{i}", "hub_name") for i in range(9)])
    v = embeddings(spark, [("a/p", [1, 0]), ("a/q", [0, 1]), ("a/r", [0.7, 0.7]), ("a/s", [0.7, 0.7])])
    pairs, _ = run_audit(spark, s, v)
    assert pairs[0] == ("a/p", "a/q") and not any(a.startswith("h/") for a, _ in pairs)


LABELS = [("a/on", "m.go", 1), ("a/prop", "m.go", 2), ("a/old", "m.go", 3), ("r/no", "m.go", 4), ("a/unknwn", "m.go", 5), ("a/abs", "d.md", 6)]


def corpus(spark):
    s = statements(spark, [("a/on", "b"), ("a/prop", "b", {"status": "proposed"}), ("a/old", "b", {"status": "superseded"}), ("a/abs", "b", {"abstract": True, "status": "superseded"}), ("a/unknown", "b")])
    r = spark.createDataFrame([("r/no", "r", "b", None)], "full_id string, namespace string, body string, see_instead string")
    lines = spark.createDataFrame([(f, n, f"x decision: {i}") for i, f, n in LABELS], "file string, line int, text string")
    return s, r, trace.scan(lines)


def test_reference_classes_and_near_misses(spark):
    s, r, refs = corpus(spark)
    c = trace.classified(refs, s, r)
    assert {(x.full_id, x["class"]) for x in c.collect()} == {("a/on", "active"), ("a/prop", "proposed"), ("a/old", "retired"), ("r/no", "rejected"), ("a/unknwn", "dangling"), ("a/abs", "abstract")}
    assert {x.full_id for x in trace.contradicting(c).collect()} == {"a/old", "r/no"}
    assert [(x.full_id, x.nearest, x.distance) for x in trace.near_misses(c, s, r).collect()] == [("a/unknwn", "a/unknown", 1)]


def test_near_misses_send_no_spread_ids_to_the_driver(spark):
    """Ids spread to their variants are no broadcast side, however small Spark takes them for; ids of no known length are not spread. Ties keep the first known id."""
    s = statements(spark, [("a/bcd", "b"), ("a/bce", "b"), ("a/a-long-one", "b")])
    r = spark.createDataFrame([("a/bcx", "a", "b", None)], "full_id string, namespace string, body string, see_instead string")
    lost = ["a/bc", "a/bcxy", "a/long-one", "b/bcde", "nowhere/at-all-1", "x/y"]
    c = spark.createDataFrame([(i, "m.go", n, "code", "dangling") for n, i in enumerate(lost)], "full_id string, file string, line int, kind string, class string")
    found = trace.near_misses(c, s, r)
    assert {(x.full_id, x.nearest, x.distance) for x in found.collect()} == {("a/bc", "a/bcd", 1), ("a/bcxy", "a/bcx", 1), ("a/long-one", "a/a-long-one", 2), ("b/bcde", "a/bcd", 2)}
    plan = found._jdf.queryExecution().toString()
    assert not any("BroadcastHashJoin" in line and "[v#" in line for line in plan.splitlines())


def test_a_files_removed_lines_are_no_one_row(spark, monkeypatch):
    """diff_gate's and diff_dropped's removed text comes in pieces of a file; labels are found as in one."""
    from corvane.operators import diffcheck
    from corvane.plans import registry

    seen, plain = [], diffcheck.removed_labels
    monkeypatch.setattr(diffcheck, "removed_labels", lambda changes: seen.append(changes) or plain(changes))
    sites = spark.range(5000).selectExpr("'src/a.go' file", "cast(id as int) line", "concat('# decision:a/', if(id % 2 = 0, 'on', 'off')) text")
    s = statements(spark, [("a/on", "b"), ("a/off", "b")])

    class Made:
        pass

    c = Made()
    c.sites, c.statements = sites.filter("line % 10 < 3 or line % 2 = 1"), s
    assert [tuple(r) for r in registry._dropped(c).collect()] == [("a/on", ["src/a.go"])]
    assert seen[0].count() == 5


def test_refiners_cover(spark):
    s = statements(spark, [("a/top", "b"), ("a/r1", "b"), ("a/r2", "b"), ("a/r3", "b", {"status": "proposed"}), ("a/lone", "b")])
    e = edges(spark, [("a/r1", "a/top", "refines"), ("a/r2", "a/top", "refines"), ("a/r3", "a/top", "refines")])
    refs = lambda ids: spark.createDataFrame([(i, "f.go", 1, "code") for i in ids], "full_id string, file string, line int, kind string")
    un = lambda ids, direct=False: {r.full_id for r in listing.unreferenced(s, e, refs(ids), direct).collect()}
    assert un(["a/r1"]) == {"a/top", "a/r2", "a/r3", "a/lone"}
    assert un(["a/r1", "a/r2"]) == {"a/r3", "a/lone"} and un(["a/r1", "a/r2"], True) == {"a/top", "a/r3", "a/lone"}
    assert un([]) == set()


PATCH = """diff --git a/one.go b/one.go
--- a/one.go
+++ b/one.go
@@ -8,3 +10,4 @@ func f()
 same
-old line decision: a/gone
+new user_ttl line
+++ counter
@@ -40 +41,2 @@
+x
+y
diff --git a/two.go b/two.go
--- a/two.go
+++ b/two.go
@@ -5,2 +5,0 @@
-gone
-gone too
diff --git a/dead.go b/dead.go
--- a/dead.go
+++ /dev/null
@@ -1 +0,0 @@
-was"""


def test_patches(spark):
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(PATCH.split("\n"))], "patch string, pos int, line string")
    hunks, changes = diffcheck.parse_patch(lines)
    assert {(r.file, r.start, r.end) for r in hunks.collect()} >= {("one.go", 10, 13), ("one.go", 41, 42), ("two.go", 5, 5)}
    got = {r.file: (r.added, r.removed) for r in changes.collect()}
    assert got["one.go"] == ("new user_ttl line\n++ counter\nx\ny", "old line decision: a/gone") and got["two.go"] == ("", "gone\ngone too") and got["dead.go"][1] == "was"
    s = statements(spark, [("a/gone", "b"), ("a/ttl", "about user_ttl")])
    none = spark.createDataFrame([], "full_id string, file string, line int, kind string")
    assert [(r.full_id, r.files) for r in diffcheck.dropped(diffcheck.removed_labels(changes), none, s).collect()] == [("a/gone", ["one.go"])]
    cover = diffcheck.covered([diffcheck.identifier_cover(changes, tables(spark, s).facets)])
    assert [(r.reason, r.full_id, r.facet) for r in cover.collect()] == [("identifier", "a/ttl", "user_ttl")]
    assert diffcheck.gate(cover, diffcheck.dropped(diffcheck.removed_labels(changes), none, s), s.limit(0)).first().failed
    assert not diffcheck.gate(cover, s.limit(0).select("full_id"), s.limit(0)).first().failed


def test_brief(spark):
    s = statements(spark, [(f"a/m{i:02d}", "rule", {"modality": "must"}) for i in range(12)] + [("a/n", "no", {"modality": "must_not"}), ("a/up", "parent")])
    r = spark.createDataFrame([("a/r", "a", "refused", None)], "full_id string, namespace string, body string, see_instead string")
    got = listing.brief(s, r, edges(spark, [("a/m00", "a/up", "refines"), ("a/m01", "a/lost", "depends_on")]), "a").collect()
    rules = sorted((x for x in got if x.section == "rules"), key=lambda x: x.pos)
    assert rules[0].full_id == "a/n" and len(rules) == 10 and rules[0].omitted == 3
    assert [(x.full_id, x.excerpt) for x in sorted((x for x in got if x.section == "parents"), key=lambda x: x.pos)] == [("a/lost", None), ("a/up", "parent")]


def test_records_change(spark):
    e = records.linked(edges(spark, [("a/x", "a/y", "refines")]), "a/x", "a/y", "refines", "why", confirmed=False)
    row = e.first()
    assert e.count() == 1 and row.note == "why" and not row.unconfirmed
    assert records.unlinked(e, "a/y", "a/x").count() == 1 and records.unlinked(e, "a/x", "a/y", "refines").count() == 0
    v = spark.createDataFrame([], "a string, b string, verdict string, note string")
    done = records.dismissed(v, "b", "a", "no")
    assert tuple(done.first())[:2] == ("a", "b") and records.dismissed(done, "a", "b", restore=True).count() == 0
    s = statements(spark, [("a/x", "see a/x and a/x-y"), ("a/z", "as a/x")])
    r = spark.createDataFrame([("r/1", "r", "not a/x", "a/x")], "full_id string, namespace string, body string, see_instead string")
    s2, r2, e2, v2 = records.moved(s, r, edges(spark, [("a/z", "a/x", "refines")]), embeddings(spark, [("a/x", [1])]), "a/x", "b/new", stub=True)
    bodies = {x.full_id: x.body for x in s2.collect()}
    assert bodies == {"b/new": "see b/new and a/x-y", "a/z": "as b/new", "a/x": "Moved to b/new."}
    assert r2.first().see_instead == "b/new" and v2.first().full_id == "b/new"
    assert {(x.from_id, x.to_id, x.type) for x in e2.collect()} == {("a/z", "b/new", "refines"), ("a/x", "b/new", "moved_to")}
    emb = embeddings(spark, [("a/x", [1, 0])])
    with pytest.raises(ValueError, match="width"):
        records.with_vectors(emb, embeddings(spark, [("a/z", [1])]))
    assert [x.full_id for x in records.with_vectors(emb, embeddings(spark, [("a/z", [1])]), force=True).collect()] == ["a/z"]
    bad = statements(spark, [("A B/x y", " ", {"status": "odd", "modality": "odd"})])
    assert set(bad.select(records.problems(bad).alias("p")).first().p) == {"id", "namespace", "body", "status", "modality"}


def test_models(spark):
    def scorer(pairs):
        if len(pairs) > 1 or "bad" in pairs[0][0]:
            raise ValueError("no")
        return [(0.0, 0.5, len(pairs[0][0]) / 100)]

    pairs = spark.createDataFrame([("aaaa", "bb"), ("bad", "c")], "body_a string, body_b string")
    cache = spark.createDataFrame([], "identity string, a_hash string, b_hash string, score double")
    scored, failed = models.contradiction(pairs, scorer, "m1", cache)
    assert [r.score for r in scored.collect()] == [0.04] and [(r.problem, r.n) for r in failed.collect()] == [("no", 1)]
    assert abs(models.chat_score([(" A", -1.0), ("(B", -1.0)]) - 0.5) < 1e-12 and models.chat_score([("B", -0.1), ("x", -3.0)]) > 0.97
    with pytest.raises(ValueError, match="neither"):
        models.chat_score([("x", -1.0)])

    def down(_):
        raise models.Unreachable("m")

    assert models.first_reachable([down, lambda t: [[1.0]] * len(t)])(["x"]) == [[1.0]]
    done = models.embedded(as_records(statements(spark, [("a/x", "one"), ("a/y", "two")])), lambda t: [[1.0, 2.0]] * len(t), "m")
    assert models.stored(embeddings(spark, [("a/x", [0, 0])]), done).count() == 2 and models.failures(done).count() == 0


def test_patch_by_lengths(spark):
    """Changed lines that look like headers, a deleted file, a hunk that is cut short, lengths that are missing or zero."""
    text = """diff --git a/one.go b/one.go
--- a/one.go
+++ b/one.go
@@ -1,3 +1,3 @@
--- gone
-x
+++ new
+y
 same
@@ -9 +9 @@
-a
+b
--- a/two.go	
+++ b/two.go	
@@ -5,2 +4,0 @@ func
--- a/fake
-+++ b/fake
diff --git a/old.go b/old.go
--- a/old.go
+++ /dev/null
@@ -1,9 +0,0 @@
-cut short
diff --git a/bin b/bin
Binary files differ
"""
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(text.split("\n"))], "patch string, pos int, line string")
    hunks, changes = diffcheck.parse_patch(lines)
    assert {(r.file, r.start, r.end) for r in hunks.collect()} == {("one.go", 1, 3), ("one.go", 9, 9), ("two.go", 4, 4), ("old.go", 0, 0)}
    assert {(r.file, r.added, r.removed) for r in changes.collect()} == {("one.go", "++ new\ny\nb", "-- gone\nx\na"), ("two.go", "", "-- a/fake\n+++ b/fake"), ("old.go", "", "cut short")}


def test_ranges_meet_by_bins(spark):
    """Short and long ranges, at and over the edges of bins, against every pair."""
    rng = np.random.default_rng(2)
    spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(1, 2000, 80), rng.choice([0, 1, 5, 300, 1500], 80))] + [(256, 256), (255, 256), (1, 5000), (512, 767)]
    h = spark.createDataFrame([("f", a, b) for a, b in spans[::2]], "file string, start int, end int")
    s = spark.createDataFrame([(f"a/{i}", "f", a, b) for i, (a, b) in enumerate(spans[1::2])] + [("a/none", "f", None, None), ("a/other", "g", 1, 9)], "full_id string, source_file string, line_start int, line_end int")
    got = [r.full_id for r in diffcheck.provenance_cover(s, h).collect()]
    assert sorted(got) == sorted(f"a/{i}" for i, (a, b) in enumerate(spans[1::2]) if any(x <= b and a <= y for x, y in spans[::2]))
    labels = spark.createDataFrame([(f"a/{k}", "f", k, "code", "active") for k in range(0, 4000, 37)], "full_id string, file string, line int, kind string, class string")
    hit = {r.line for r in diffcheck.label_cover(labels, h.filter("end < 3000")).collect()}
    assert hit == {k for k in range(0, 4000, 37) if any(x <= k <= y < 3000 for x, y in spans[::2])}
