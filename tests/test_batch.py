"""Batches: what refuses a line, what refuses all, and the replay against one that takes line after line."""

import hashlib
import json
import random

import pytest

from corvane import config
from corvane.functions import constants as C
from corvane.operators import records
from corvane.plans import batch
from tests.test_operators import statements

EDGE = "from_id string, to_id string, type string, note string, via string, unconfirmed boolean"


def lines_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "line_no bigint, text string")


def store(spark, s, rejected=(), linked=(), judged=(), cleared=()):
    return batch.Store(
        statements(spark, s), spark.createDataFrame([(i, i.rpartition("/")[0], "b", None) for i in rejected], "full_id string, namespace string, body string, see_instead string"),
        spark.createDataFrame([(a, b, t, n, v, u) for a, b, t, n, v, u in linked], EDGE), spark.createDataFrame([(a, b, "not_related", None) for a, b in judged], "a string, b string, verdict string, note string"),
        spark.createDataFrame(list(cleared), "id string, body_hash string, note string"),
    )


def replay(texts, s, rejected, linked, judged, dup=()):
    """One operation after the other on dictionaries."""
    st = {i: {"body": b, "status": "active", "modality": None} for i, b in s}
    rej, verdicts, cleared, out = set(rejected), {tuple(sorted(p)): None for p in judged}, {}, []
    edges = {(a, b, t): [n, v, u] for a, b, t, n, v, u in linked}
    for no, text in enumerate(texts, 1):
        if not text.strip() or text.strip().startswith("#"):
            continue
        o = json.loads(text)
        op, get = o["op"], lambda k: o.get(k) or ""  # noqa: B023
        own, problem = f"{get('namespace')}/{get('id')}", None
        slug = all(x.isalnum() and x == x.lower() for x in get("id").split("-"))
        if op == "add":
            problem = "exists" if own in st else "duplicate" if no in dup and not o.get("duplicate_ok") else None if slug else "invalid id"
            if not problem and get("status") and get("status") not in C.STATUSES:
                problem = "invalid status"
            if not problem:
                st[own] = {"body": get("body"), "status": get("status") or "active", "modality": get("modality") or None}
        elif op == "reject":
            problem = "exists" if own in rej else "see_instead not found" if get("see_instead") and get("see_instead") not in st else None if slug else "invalid id"
            if not problem:
                rej.add(own)
        elif op == "update":
            own = get("full_id")
            problem = "not found" if own not in st else "invalid modality" if get("modality") not in ("", "none", *C.MODALITIES) else None
            if not problem:
                for k in ("body", "status", "modality"):
                    if get(k):
                        st[own][k] = None if (k, get(k)) == ("modality", "none") else get(k)
        else:
            own, a, b, t = get("from"), get("from"), get("to"), get("type")
            if op == "link":
                problem = "not_related is a verdict" if t == "not_related" else "from not found" if a not in st else "to not found" if b not in st else None if t in C.EDGE_TYPES else "unknown type"
                if not problem and (a, b, t) in edges:
                    e = edges[a, b, t]
                    edges[a, b, t] = [get("note") or e[0], e[1], e[2] and not o.get("confirmed")]
                elif not problem:
                    edges[a, b, t] = [get("note") or None, "batch", not o.get("confirmed")]
            elif op == "unlink":
                gone = [k for k in edges if k[:2] == (a, b) and (not t or k[2] == t)]
                problem = "unknown type" if t and t not in C.EDGE_TYPES else "from not found" if a not in st else None if gone else "no such edge"
                for k in gone if not problem else []:
                    del edges[k]
            elif o.get("open_wording"):
                problem = None if a in st else "from not found"
                if not problem:
                    cleared[a] = hashlib.sha256(st[a]["body"].encode()).hexdigest()
            else:
                problem = "from not found" if a not in st else None if b in st else "to not found"
                if not problem:
                    verdicts[tuple(sorted((a, b)))] = get("note") or None
        out.append((no, op, own, problem is None, problem))
    return out, st, rej, edges, verdicts, cleared


def random_batch(rnd, n=260):
    ids = [f"a/r{i}" for i in range(6)] + ["b/new1", "b/new2", "b/new3", "c/none"]
    some, out = lambda: rnd.choice(ids), []
    for _ in range(n):
        op = rnd.choice(["add", "link", "link", "link", "unlink", "unlink", "update", "dismiss", "reject", "note"])
        if op == "note":
            out.append(rnd.choice(["# section", "", "   "]))
            continue
        o = {"op": op}
        if op == "add":
            o |= {"namespace": "b", "id": rnd.choice(["new1", "new2", "new3", "Bad"]), "kind": "rule", "body": f"body {len(out)}", "duplicate_ok": rnd.random() < 0.3}
            if rnd.random() < 0.2:
                o["status"] = rnd.choice(["proposed", "odd"])
        elif op == "reject":
            o |= {"namespace": "b", "id": rnd.choice(["no1", "no2"]), "body": "x", "see_instead": rnd.choice(["", some()])}
        elif op == "update":
            o |= {"full_id": some(), rnd.choice(["body", "status", "modality"]): rnd.choice(["deprecated", "none"])}
            o = {k: (v if k != "status" else "deprecated") for k, v in o.items()} | ({"modality": rnd.choice(["must", "none", "odd"])} if rnd.random() < 0.4 else {})
        elif op == "dismiss" and rnd.random() < 0.5:
            o |= {"from": some(), "open_wording": True}
        else:
            o |= {"from": some(), "to": some()}
            if op == "link" or (op == "unlink" and rnd.random() < 0.6):
                o["type"] = rnd.choice(["refines", "depends_on", "odd", "not_related"] if rnd.random() < 0.2 else ["refines", "depends_on"])
            if rnd.random() < 0.5:
                o["note"] = f"n{len(out)}"
            if op == "link" and rnd.random() < 0.3:
                o["confirmed"] = True
        out.append(json.dumps(o))
    return out


def test_replay_is_that_of_line_after_line(spark):
    texts = random_batch(random.Random(1))
    s = [(f"a/r{i}", f"old {i}") for i in range(6)]
    linked = [("a/r0", "a/r1", "refines", "kept", None, True), ("a/r2", "a/r1", "duplicates", None, "mv", False), ("a/r5", "x/other", "refines", None, None, False)]
    dup = {k for k, t in enumerate(texts, 1) if k % 11 == 0}
    args = (["b/no2"], linked, [("a/r0", "a/r1")])
    want, st, rej, edges, verdicts, cleared = replay(texts, s, *args, dup=dup)
    results, after = batch.applied(lines_of(spark, texts), store(spark, s, *args), spark.createDataFrame([(k,) for k in sorted(dup)], "line_no bigint"))
    assert [tuple(r) for r in results.select(*batch.RESULTS).collect()] == want
    assert {r.full_id: {"body": r.body, "status": r.status, "modality": r.modality} for r in after.statements.collect()} == st
    assert {r.full_id for r in after.rejections.collect()} == rej
    assert {(r.from_id, r.to_id, r.type): [r.note, r.via, r.unconfirmed] for r in after.edges.collect()} == edges
    assert {(r.a, r.b): r.note for r in after.verdicts.collect()} == verdicts
    assert {r.id: r.body_hash for r in after.clearances.collect()} == cleared
    assert {p for *_, p in want} >= {None, "exists", "not found", "no such edge", "to not found"}


BAD = [
    ("{", "malformed"), ("[1]", "malformed"), ("5", "malformed"), ('{"op":1}', "malformed"), ('{"op":"link","from":"a","to":"b","type":"refines","confirmed":"yes"}', "malformed"), ('{"op":"add","tags":"x"}', "malformed"),
    ("null", "missing op"), ("{}", "missing op"), ('{"op":"supersede"}', "unknown op"), ('{"op":"add","namespace":"auth"}', "missing id,kind,body"), ('{"op":"update","full_id":"x"}', "nothing to update"),
    ('{"op":"dismiss","from":"x"}', "missing to"), ('{"op":"dismiss","from":"x","to":"y","open_wording":true}', "open_wording clears one statement"), ('{"op":"unlink","from":"x"}', "missing to"),
]


def test_one_line_that_is_none_refuses_the_batch(spark):
    good = '{"op":"add","namespace":"auth","id":"hashed","kind":"rule","body":"Tokens are hashed.","tags":[]}'
    checked = records.batch(lines_of(spark, [good, *[t for t, _ in BAD]])).collect()
    assert {r.line_no: r.problem for r in checked} == {1: None} | {k: p for k, (_, p) in enumerate(BAD, 2)}
    for bad in ('{"op":"add","namespace":"auth"}', "{"):
        results, after = batch.applied(lines_of(spark, [good, bad, "# note"]), store(spark, [("a/x", "b")]))
        assert [(r.line_no, r.applied) for r in results.collect()] == [(1, False), (2, False)]
        assert after.statements.count() == 1
    long = "# " + "x" * C.BATCH_LINE_BYTES
    assert [r.problem for r in records.batch(lines_of(spark, [good, long])).orderBy("line_no").collect()] == [None, "too long"]
    for texts, applies in (([good], True), ([], False), (["# only", " "], False), ([good, long], False)):
        assert records.batch_summary(records.batch(lines_of(spark, texts))).first().applies is applies


def test_results_name_the_files_lines(spark):
    texts = ['{"op":"add","namespace":"auth","id":"hashed","kind":"rule","modality":"must","body":"b"}', "# headings and blank lines are skipped", "", '{"op":"add","namespace":"p","id":"least","kind":"design","body":"c"}', '{"op":"link","from":"auth/hashed","to":"p/least","type":"refines"}', '{"op":"reject","namespace":"auth","id":"cache","body":"d"}']
    results, after = batch.applied(lines_of(spark, texts), store(spark, []))
    assert [(r.line_no, r.full_id, r.applied) for r in results.collect()] == [(1, "auth/hashed", True), (4, "p/least", True), (5, "auth/hashed", True), (6, "auth/cache", True)]
    assert [(r.from_id, r.to_id, r.via, r.unconfirmed) for r in after.edges.collect()] == [("auth/hashed", "p/least", "batch", True)]


def test_layers():
    assert config.merged({"machine": {"a": {"b": 1, "c": 2}}, "local": {"a": {"c": 3}}}) == {"a": {"b": 1, "c": 3}}
    with pytest.raises(ValueError, match="keys"):
        config.merged({"shared": {"keys": {}}})


def test_a_batch_is_parsed_once(spark):
    """Nothing after the first step makes a line's object again, once a field or once a table."""
    lines = lines_of(spark, ['{"op":"link","from":"a/x","to":"a/y","type":"refines"}', '{"op":"update","full_id":"a/x","status":"active"}'])
    out, after = batch.applied(lines, store(spark, [("a/x", "b"), ("a/y", "b")]))
    for table in (out, after.statements, after.edges, after.verdicts, after.clearances):
        assert "parse" not in table._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [tuple(r) for r in out.collect()] == [(1, "link", "a/x", True, None), (2, "update", "a/x", True, None)]
