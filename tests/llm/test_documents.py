import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corvane.llm import crf, decontaminate, line_dedup, minhash, quality, shards

LINE = "This Line is held by many documents, and long."


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_line_dedup(spark, docs, odd):
    data = [*odd, *((20 + i, f"own {i}\n  {LINE.lower() if i % 2 else LINE}\t\n{LINE}\nend") for i in range(5)), (30, "\n".join(["short"] * 9)), (31, "short")]
    held = defaultdict(set)
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    for i, t in data:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    want = []
    for i, t in data:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 40 or len(held[key(x)]) < 5 or i == max(held[key(x)])]
        want.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    got = rows(line_dedup.line_report(docs(data)))
    assert set(got) == set(want) and len(set(got)) == len(set(want))
    out = line_dedup.dedup_lines(docs(data))
    assert {"size", "key", "line", "lang"} <= set(out.columns)
    assert out.filter("doc_id = 21").first().text == "own 1\nend" and LINE in out.filter("doc_id = 24").first().text
    assert line_dedup.line_report(docs([])).count() == 0


def test_line_dedup_counts_documents(spark, docs):
    """Rows of one doc_id are one document: a line in two documents stays, however often their rows repeat; in five it goes."""
    two = [(1, f"a\n{LINE}")] * 4 + [(2, LINE)]
    assert {tuple(r)[:3] for r in line_dedup.line_report(docs(two)).collect()} == {(1, 2, 0), (2, 1, 0)}
    more = two + [(i, f"{LINE}\nx") for i in (3, 4)] + [(None, LINE)]
    got = [tuple(r)[:3] for r in line_dedup.line_report(docs(more)).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1)] * 4 + [(2, 1, 1), (3, 2, 1), (4, 2, 0), (None, 1, 1)], key=str)
    assert {tuple(r)[:3] for r in line_dedup.line_report(docs(more[:-1])).collect()} == {(1, 2, 0), (2, 1, 0), (3, 2, 0), (4, 2, 0)}


def test_line_dedup_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, LINE, 7, "p", [3], 5)], "doc_id bigint, text string, n_lines int, `a.b` string, _lines array<int>, _dropped int")
    got = line_dedup.dedup_lines(df, keep_names=True)
    assert got.dtypes == df.dtypes and got.collect() == df.collect()
    assert line_dedup.dedup_lines(df).select("n_lines", "`a.b`", "_lines", "_dropped").first() == (1, "p", [3], 5)


def repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len({j for i, x in enumerate(win) if n[x] > 1 for j in (i, i + 1, i + 2)})


def test_quality_counts(spark, docs, odd):
    rng = np.random.default_rng(2)
    data = [*odd, *((100 + i, " ".join(rng.choice(["a", "b", "c", "d"], 5 + i))) for i in range(60)), (200, "x y\nx y\n\nx y z\nx y")]
    got = {tuple(r)[:6] for r in quality.report(docs(data)).collect()}
    assert got == {(i, *repeats(t)) for i, t in data}
    assert quality.report(docs([])).count() == 0


def test_quality_keeps_clean_and_drops_odd(spark, docs):
    rng = np.random.default_rng(3)
    clean = [(i, " ".join("".join(rng.choice(list("abcdefg"), rng.integers(2, 9))) for _ in range(120))) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "###" for w in t.split())) for i, t in clean[:10]]
    kept = {r.doc_id for r in quality.keep_good(docs(clean + junk + [(2000, "too short"), (2001, None)])).collect()}
    assert kept == {i for i, _ in clean}


def test_shards(spark, docs, odd):
    data = [*odd, *((100 + i, f"t{i % 7}") for i in range(3000))]
    got = shards.place(docs(data)).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in data)
    assert all(r.grown_shard in (r.shard, 24) for r in got) and 40 < sum(r.grown_shard == 24 for r in got) < 220
    assert {len({r.shard for r in got if r.doc_id == 8})} == {1}
    for s in range(24):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own))) and 80 < len(own) < 180
    draw = lambda k, s: -np.log(((xxhash.xxh64_intdigest(int(s).to_bytes(4, "little"), xxhash.xxh64_intdigest(str(k), 42)) >> 11) + 0.5) / 2**53)
    for r in got[:200]:
        assert r.shard == min(range(24), key=lambda s: draw(r.doc_id, s))
    assert shards.place(docs([])).count() == 0


def test_a_changed_weight_moves_rows_to_its_shard_only(spark):
    df = spark.range(4000)
    a = shards.with_shard(df, F.col("id").cast("string"), 24, "s")
    b = shards.with_shard(a, F.col("id").cast("string"), 24, "t", {5: 2.0})
    moved = b.filter("s <> t").collect()
    assert moved and all(r.t == 5 for r in moved)


def components(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_minhash_equals_brute_force(spark, docs, odd):
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in rng.integers(0, 5000, 120)]
    data = [r for r in odd if r[0] != 8] + [(8, "!!! ###")]
    for i in range(120):  # a family whose members differ from each other by degrees, in random order of ids
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 9)):
            w[j] = f"n{rng.integers(0, 10**6)}"
        data.append((int(1000 + i * 7 % 120), " ".join(w).upper() if i % 3 == 0 else " ".join(w)))
    data += [(3000 + i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 30))) for i in range(40)]
    for words, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: r for r in minhash.report(docs(data), minhash.Rule(words, percent)).collect()}
        sets = {i: shingle(t, words) for i, t in data}
        want = components(sets, percent)
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())
    kept = {r.doc_id for r in minhash.keep_first(docs(data)).collect()}
    assert kept == {i for i, r in want.items() if i == r}
    assert minhash.report(docs([])).count() == 0


def edited(base, places):
    return " ".join(f"x{k}" if k in places else w for k, w in enumerate(base))


def test_minhash_links_any_two_members_of_a_bucket(spark, docs, monkeypatch):
    """One bucket: 2 is like 70 only, which is one of many members of the centre's component."""
    base = [f"v{i}" for i in range(120)]
    data = [(1, " ".join(base)), *((10 + i, edited(base, {3 * i})) for i in range(39) if i != 20), (70, edited(base, {20, 60})), (2, edited(base, {20, 60, 100}))]
    sets = {i: shingle(t, 3) for i, t in data}
    like = {i for i in sets if 100 * len(sets[2] & sets[i]) >= 90 * len(sets[2] | sets[i])}
    assert like == {2, 70}
    sketch = minhash.sketch
    monkeypatch.setattr(minhash, "sketch", lambda d, r: sketch(d, r).withColumn("bands", F.expr("transform(bands, (x, i) -> cast(i as bigint))")))
    got = {r.doc_id: r.component_id for r in minhash.report(docs(data), minhash.Rule(3, 90)).collect()}
    assert got == components(sets, 90) and set(got.values()) == {1}


def test_minhash_confirms_pairs_of_one_band(spark, docs, monkeypatch):
    base = [f"v{i}" for i in range(120)]
    data = [(1, " ".join(base)), (2, edited(base, {60})), (3, edited(base, set(range(0, 120, 4))))]
    sketch = minhash.sketch
    monkeypatch.setattr(minhash, "sketch", lambda d, r: sketch(d, r).withColumn("bands", F.expr("transform(bands, (x, i) -> if(i = 5, 5, 1000 * doc_id + i))")))
    got = {r.doc_id: r.component_id for r in minhash.report(docs(data)).collect()}
    assert got == components({i: shingle(t, 3) for i, t in data}, 85) == {1: 1, 2: 1, 3: 3}


def test_minhash_repeated_rows_and_null_ids(spark, docs):
    out = minhash.report(docs([(1, "a b c d"), (1, "a b c d"), (2, "A B c d"), (None, "a b c d"), (3, None)])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id is not None) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]


def test_decontamination(spark, docs, odd):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("al", "or", "in", "et", "us", "am", "op", "ik")]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(i, " ".join(f"{w}{i}" if k % 3 == 0 else w for k, w in enumerate(text(40).split()))) for i in range(8)] + [(90, None), (91, ""), (92, "two words")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    data = list(odd) + [(100 + i, text(300)) for i in range(200)]
    for i, t in items[:8]:
        w = t.split()
        data.append((500 + i, f"{text(97)} {t} {text(50)}"))
        data.append((600 + i, f"{text(31)} {' '.join(x for k, x in enumerate(w) if k % 6)}, {text(9)}"))  # every sixth word lost
        data.append((700 + i, f"{text(60)} {' '.join(w[:8])} {text(60)}"))  # a short quotation
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(data), bench).collect()}
    assert got == {(b + i, i) for i in range(8) for b in (500, 600)}
    clean = decontaminate.keep_clean(docs(data), bench)
    assert clean.columns == docs([]).columns and {r.doc_id for r in clean.collect()} == {i for i, _ in data} - {d for d, _ in got}
    assert decontaminate.matches(docs([]), bench).count() == decontaminate.matches(docs(data), bench.limit(0)).count() == 0


def test_decontamination_of_often_leaked_items(spark, docs):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 400, n))
    items = [(i, " ".join(f"p{i}x{k}" if k % 2 else f"t{rng.integers(0, 400)}" for k in range(30))) for i in range(4)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    data, want = [], set()
    for d in range(120):
        i = d % 6  # each item is in a sixth of the documents
        if i < 4:
            w = items[i][1].split()
            body = " ".join(w if d % 5 else [x for k, x in enumerate(w) if k % 6])
            want.add((d, i))
        data.append((d, f"{text(70)} {body if i < 4 else text(30)} {text(40)}"))
    found = decontaminate.matches(docs(data), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    assert {r.doc_id for r in decontaminate.keep_clean(docs(data), bench).collect()} == {d for d, _ in data} - {d for d, _ in want}
    few = [(d, f"{text(20)} {items[0][1]}") for d in range(2)] + [(9, text(50))]  # fewer documents than make any weight
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(few), bench).collect()} == {(0, 0), (1, 0)}


def test_decontamination_pages_by_item_and_text(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 3)
    ids = [1, 5, 5, 5, 5, 5, 7, None, None]
    items = [(i, " ".join(f"p{k}x{j}" for j in range(20))) for k, i in enumerate(ids)]
    data = [(k, f"before it {t} after it") for k, (_, t) in enumerate(items)] + [(50, f"{items[1][1]} {items[5][1]}"), (51, "clean text of some words")]
    bench = spark.createDataFrame([*items, items[3]], "item_id bigint, text string")
    found = [(r.doc_id, r.item_id) for r in decontaminate.matches(docs(data), bench).collect()]
    assert sorted(found, key=str) == sorted([*enumerate(ids), (50, 5)], key=str)
    assert [r.doc_id for r in decontaminate.keep_clean(docs(data), bench).collect()] == [51]


def test_crf_labels(spark, docs, odd):
    rng = np.random.default_rng(6)
    parts = {"en": ["th", "sh", "ing", "wh", "ow"], "de": ["sch", "ei", "ung", "ü", "ch"], "es": ["ción", "ll", "ñ", "os", "ue"]}
    make = lambda lang, n: " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(n))
    data = [(i, make(lang, 5 + i % 90), lang) for i in range(400) for lang in [["en", "de", "es"][i % 3]]]
    df = docs(data)
    got = {r.doc_id: r for r in crf.predict(df).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(i, lang) for i, _, lang in data if got[i].held_out]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.98
    model = crf.fitted(df)
    mixed = make("en", 30) + " " + make("de", 30)
    words = crf.label_words(docs([(1, mixed)]), model).first().words
    assert [w.lang for w in words][:25] == ["en"] * 25 and [w.lang for w in words][-25:] == ["de"] * 25
    strange = {r.doc_id: r.lang_pred for r in crf.predict(docs(odd), model).collect()}
    assert {strange[i] for i in (1, 2, 3, 8)} == {"und"}
    assert crf.predict(docs([])).count() == 0
    assert {r.lang_pred for r in crf.predict(docs([(2, "no labels")]).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rows_that_share_an_id_lose_their_own_lines(spark, docs):
    long = "a line that is long enough to be counted by the operator"
    data = [(i, f"own {i}\n{long}") for i in range(5)] + [(None, f"{long}\nfirst"), (None, "second\nthird\n" + long), (2, "another text")]
    got = {r.text: (r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs(data)).collect()}
    assert got == {**{f"own {i}": (2, 1) for i in range(4)}, f"own 4\n{long}": (2, 0), "first": (2, 1), "second\nthird": (3, 1), "another text": (1, 0)}


def test_quality_tells_rows_of_one_id_apart(spark):
    good = " ".join(f"word{k} of text" for k in range(40))
    rows = [(1, good, "en", "a"), (1, "bad", "en", "a"), (None, good + " x", None, None), (None, "bad too", None, "b"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as n_words", "'q' as measure", "2 as _row")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.text for r in kept.collect()) == sorted([good, good + " x"])
    report = quality.report(df).collect()
    assert len(report) == 5 and sum(r.kept for r in report) == 2
