"""Token alignment against plain Python."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import alignment, vocab


def brute_alignment(rows):
    """The contract by sets of byte offsets, one text after the other."""
    a_tok = Tokenizer.from_file(vocab.default_path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=vocab.default_path("piece_bpe_32k.model"))
    bare = {chr(c): b for b, c in vocab.byte_characters().items()}
    out, holders = [], defaultdict(set)
    for k, (doc, text) in enumerate(rows):
        text = text or ""
        a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        ba = [bytes(bare[c] for c in a_tok.id_to_token(i)) for i in a]
        bb = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            out.append((doc, None, []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (ba, bb)]
        groups = []
        for end in sorted(set(ends[0]) & set(ends[1])):
            i, j = sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups)
            groups.append((a[i : ends[0].index(end) + 1], b[j : ends[1].index(end) + 1]))
        links = Counter((x, y) for g, h in groups for x in g for y in h)
        for pair in links:
            holders[pair].add(("row", k) if doc is None else doc)
        out.append((doc, groups, links))
    count = {p: len(x) for p, x in holders.items()}
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    done = []
    for doc, groups, links in out:
        if groups is None:
            done.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        n_best = sum(n for p, n in links.items() if count[p] == best[p[0]])
        done.append((doc, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()), n_best, sum(n * count[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(done, key=str)


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    (20, "Internationalization of tokenizers; naïve café déjà-vu 漢字かな交じり文 🙂🙂 «quoted»"),
    (21, "a▁b is not given back"),
    (22, "<|endoftext|> and </s> are plain <unk> <s>"),
    (23, "  two  spaces   three    four\n\n\ttabs\t\r\nend "),
    (24, "=" * 300 + "-" * 77 + "aaaaaaaaaaaaaaaaaaaaaaaaa" + "xyz" * 40),
    (None, "no id here"),
    (None, "no id here"),
    (25, "one\x00two\x1cthree ́ combining ﬁ Å"),
]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)


def test_alignment_equals_offsets(spark, docs, odd):
    """With room in the broadcast table for all pairs, for few, and for none."""
    rows = [(i, t) for i, t in odd if i != 5] + TEXTS
    done, width = alignment.aligned(docs(rows))
    want = brute_alignment(rows)
    rates = alignment.rated(alignment.pair_counts(done.cache()), width).cache()
    for most in (1 << 18, 40, 0):
        assert rows_of(alignment.totals(done, rates, most)) == want


def test_expansion_in_parts_is_whole():
    """Links of a large group come out once, however small the parts, and an A id of a text is in one of them."""
    rng = np.random.default_rng(3)
    text = np.repeat(np.arange(3), 4)
    ga, gb = np.sort(rng.integers(0, 12, 300)), np.sort(rng.integers(0, 12, 260))
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 260)
    want = Counter((int(text[g]), int(x) * 7 + int(y)) for g, x in zip(ga, a) for h, y in zip(gb, b) if g == h)
    for part in (1, 5, 50, 1 << 21):
        alignment.PART, had = part, alignment.PART
        try:
            got, owners = {}, defaultdict(set)
            for k, (t, pair, n) in enumerate(alignment.expanded(text, ga, a, gb, b, 7)):
                for i, p, m in zip(t.tolist(), pair.tolist(), n.tolist()):
                    assert (i, p) not in got
                    got[i, p] = m
                    owners[i, p // 7].add(k)
        finally:
            alignment.PART = had
        assert got == want and all(len(x) == 1 for x in owners.values())


def test_alignment_of_nothing_and_repeats(spark, docs):
    assert alignment.report(docs([])).collect() == []
    rows = [(1, "the same words twice"), (1, "the same words twice"), (1, "the other words"), (2, "the same words"), (3, None)]
    assert rows_of(alignment.report(docs(rows))) == brute_alignment(rows)


def test_union_of_chains():
    """Components by union-find, in any order of edges."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 700):
        x, y = rng.integers(0, n, n // 2), rng.integers(0, n, n // 2)
        want = list(range(n))
        for p, q in zip(x, y):
            a, b = want[p], want[q]
            want = [min(a, b) if w in (a, b) else w for w in want]
        assert alignment.union(n, x, y).tolist() == want
    chain = np.arange(999)
    assert not alignment.union(1000, chain[::-1], chain[::-1] + 1).any()
