"""The index against the full scan, after adds, edits, removals and merges."""

import random

import pytest

from corvane.operators import index as X
from corvane.operators import lexical

WORDS = "cancel cancels cancelled order orders café naïve rate limit token tokens hashed stored never always api-key user-id must may".split()
SCHEMA = "source_kind string, full_id string, namespace string, body string, tags array<string>"


def corpus(rnd, n=120):
    out = {}
    for i in range(n):
        kind = "statement" if i % 4 else "rejection"
        body = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 30))) + (" zebra" if i == 7 else "")
        out[kind, f"a{i % 3}/r{i}"] = (f"a{i % 3}", body, ["x", "rate"] if i % 5 == 0 else [])
    return out


def frame(spark, held):
    return spark.createDataFrame([(*k, *v) for k, v in held.items()], SCHEMA)


def scan(records, phrases, stemmed):
    tok = lexical.tokenised(records)
    if stemmed:
        tok = lexical.stemmed_for(tok, phrases)
    counts = lexical.corpus_counts(tok, phrases)
    return counts, sorted((r.source_kind, r.full_id, round(r.score, 9)) for r in lexical.bm25(tok, phrases, counts).collect())


def read(index, phrases):
    counts = index.counts(phrases)
    return counts, sorted((r.source_kind, r.full_id, round(r.score, 9)) for r in index.scores(phrases, counts).collect())


def same(spark, index, held, draft="cancelling the api-key limits user-id zebra cancelling unseen"):
    records = frame(spark, held)
    phrases = lexical.draft_phrases(spark, draft, index.stemmed)
    counts, scores = scan(records, phrases, index.stemmed)
    mine, got = read(index, phrases)
    assert got == scores and len(scores) > 10
    assert {k: (c["n"], round(c["avgdl"], 9), c["token"], c["phrase"]) for k, c in mine.items()} == {k: (c["n"], round(c["avgdl"], 9), c["token"], c["phrase"]) for k, c in counts.items()}


def test_refresh_equals_the_full_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SEGMENTS", 3)
    rnd = random.Random(8)
    held, index = corpus(rnd), X.Index(spark, str(tmp_path / "i"))
    assert index.refresh(frame(spark, held)) == {"added": 120}
    same(spark, index, held)
    assert index.refresh(frame(spark, held)) == {"unchanged": 120} and index.version()["number"] == 1
    for step in range(4):  # the fourth segment sets off a merge
        keys = sorted(held)
        for k in keys[step::40]:
            del held[k]
        for k in keys[step + 5 :: 30]:
            if k in held:
                ns, body, tags = held[k]
                held[k] = (ns, body + " cancels api-key", tags)
        held["statement", f"new/{step}"] = ("new", "a limit on orders by user-id", ["cancel"])
        got = index.refresh(frame(spark, held))
        assert got["added"] == 1 and got["removed"] >= 3 and got["updated"] >= 3
        if step in (1, 3):
            same(spark, index, held)
    assert len(index.version()["segments"]) < 5
    before = index.version()["number"]
    index.merge(whole=True)
    assert len(index.version()["segments"]) == 1 and index.version()["number"] == before + 1
    assert index.vacuum() and index.vacuum() == []
    same(spark, index, held)


def test_a_read_touches_only_its_terms(spark, tmp_path):
    held, index = corpus(random.Random(9)), X.Index(spark, str(tmp_path / "i"), stemmed=False)
    index.refresh(frame(spark, held))
    plan = index.blocks(index.version(), ["zebra"])._jdf.queryExecution().toString()
    assert "(bucket#" in plan and "PartitionFilters: [" in plan and f"= {X.bucket_of('zebra')})" in plan and "PushedFilters: [" in plan and "zebra" in plan.split("PushedFilters")[1]
    same(spark, index, held, "cancels api-key orders")


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_top_skips_shards_and_loses_no_record(spark, tmp_path, monkeypatch, k):
    """Rare words in few of many small shards; the page is that of all scores."""
    monkeypatch.setattr(X, "SHARD", 4)
    monkeypatch.setattr(X, "PROBE", 2)
    rnd = random.Random(k)
    held = {("statement", f"n{i % 20:02d}/r{i}"): (f"n{i % 20:02d}", " ".join(rnd.choice(WORDS[i % 7 : i % 7 + 6]) for _ in range(12)), []) for i in range(200)}
    for i in (3, 23, 43):
        held["statement", f"n03/r{i}"] = ("n03", "zebra crossing user-id zebra", [])
    index = X.Index(spark, str(tmp_path / "i"))
    index.refresh(frame(spark, held))
    phrases = lexical.draft_phrases(spark, "zebra crossing user-id hashed", True)
    eligible = frame(spark, {key: v for key, v in held.items() if not key[1].endswith("3")} | {("statement", "n03/r23"): held["statement", "n03/r23"]})
    names = {r.full_id for r in eligible.collect()}
    _, scores = scan(frame(spark, held), phrases, True)
    want = [i for _, i in sorted((-s, i) for _, i, s in scores if i in names)][:k]
    got = index.top(phrases, index.counts(phrases), eligible, k, report=True).orderBy("pos").collect()
    assert [r.full_id for r in got] == want and [r.pos for r in got] == list(range(1, len(want) + 1))
    assert index.pruned["scored"] <= index.pruned["shards"] and (k > 1 or index.pruned["scored"] < index.pruned["shards"] / 2)


def test_a_lost_refresh_leaves_the_old_version(spark, tmp_path, monkeypatch):
    held, index = corpus(random.Random(10), 60), X.Index(spark, str(tmp_path / "i"))
    index.refresh(frame(spark, held))
    more = held | {("statement", "b/new"): ("b", "cancel everything", [])}
    with monkeypatch.context() as m:
        m.setattr(X.Index, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.refresh(frame(spark, more))
    assert index.version()["number"] == 1
    same(spark, index, held, "cancel orders limit")
    assert index.refresh(frame(spark, more)) == {"added": 1, "unchanged": 60}
    same(spark, index, more, "cancel orders limit")
    assert index.refresh(frame(spark, more).limit(0)) == {"removed": 61} and index.version()["totals"] == {}
    assert read(index, [["cancel"]])[1] == []


def test_postings_are_made_where_the_records_lie(spark, tmp_path, monkeypatch):
    """Nothing is shuffled to write a segment; a record given twice is one; blocks hold what a plain loop finds."""
    monkeypatch.setattr(X, "SHARD", 4)
    monkeypatch.setattr(X, "AT_ONCE", 3)  # shards are cut by it, and by batches
    held, index = corpus(random.Random(11), 50), X.Index(spark, str(tmp_path / "i"), stemmed=False)
    twice = frame(spark, held).unionByName(frame(spark, {k: v for k, v in held.items() if k[1].endswith("/r9")}))
    assert index.refresh(frame(spark, {})) == {} and index.version()["number"] == 0
    assert index.refresh(twice) == {"added": 51}
    docs = index.docs(index.version())
    made = X.inverted(docs)
    assert "Exchange" not in made._jdf.queryExecution().toString()
    want = {}
    for r in docs.collect():
        for pos, term in enumerate(r.terms):
            if term:
                want.setdefault((r.source_kind, r.shard, term), {}).setdefault((r.full_id, r.dl), []).append(pos)
    got = {}
    for r in index._read(index.version(), "postings").collect():
        block = {(x.full_id, x.dl): sorted(x.positions) for x in r.records}
        assert (r.source_kind, r.shard, r.term) not in got and r.n == len(block) and all(x.tf == len(x.positions) for x in r.records)
        assert r.max_tf == max(x.tf for x in r.records) and r.min_dl == min(x.dl for x in r.records)
        got[r.source_kind, r.shard, r.term] = block
    assert got == {k: {d: sorted(p) for d, p in v.items()} for k, v in want.items()}
