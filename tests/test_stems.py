"""The stemmer in SQL against the one in Python, and the forms of stems."""

import random

import duckdb
import pandas as pd

from corvane.functions.porter import STEP2, STEP3, STEP4, stem
from corvane.operators import lexical
from corvane.plans.stem_sql import stems


def made_words(n=5_000):
    draw = random.Random(5)
    ends = [e for e, _ in STEP2 + STEP3] + STEP4 + ["", "s", "sses", "ies", "ed", "ing", "eed", "y", "ll", "e", "ying"]
    return sorted({"".join(draw.choice("aeiouybcdlstrmnpwxz") for _ in range(draw.randint(1, 6))) + draw.choice(ends) + draw.choice(["", "", "s", "ed", "ing"]) for _ in range(n)} | {"yy", "é", "naïves", "a1s"})


def test_sql_stems_like_python():
    words = pd.DataFrame({"w": made_words()})  # noqa: F841
    got = dict(duckdb.sql(f"WITH {stems('words')} SELECT w, s FROM stem").fetchall())
    assert got == {w: stem(w) for w in words["w"]}


def test_words_begin_like_their_stems():
    assert all(w.startswith(stem(w)[: max(1, len(stem(w)) - 2)]) for w in made_words())


def test_stemmed_draft_finds_all_forms(spark):
    rows = [("statement", f"a/{i}", "a", body, []) for i, body in enumerate(["Relational stores", "we relate things", "relations", "relative", "unrelated", None])]
    df = spark.createDataFrame(rows, "source_kind string, full_id string, namespace string, body string, tags array<string>")
    phrases = lexical.draft_phrases(spark, "relating store/things", stemmed=True)
    tok = lexical.tokenised(df)
    assert lexical.forms(tok, ["relat"]) == {w: "relat" for r in rows if r[3] for w in r[3].lower().split() if stem(w) == "relat"}
    found = {r.full_id: {x.term: x.tf for x in r.found} for r in lexical.matches(lexical.stemmed_for(tok, phrases), phrases).collect() if r.found}
    assert found["a/0"] == {"relat": 1, "store": 1} and found["a/1"]["relat"] == 1 and "a/4" not in found
