import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.porter import stem


def value(spark, column, **cols):
    row = spark.createDataFrame([tuple(cols.values()) or (1,)], list(cols) or ["one"])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("the user_session_ttl column", ["user_session_ttl"]),
        ("an :atom_name here, :ok", ["atom_name"]),
        ("see orders.customer_id and config.yml.", ["config.yml", "customer_id", "orders.customer_id"]),
        ("parseToken and SessionStore", ["parsetoken", "sessionstore"]),
        ("plain prose names nothing", []),
        ("e.g. this, i.e. that, a_b too", []),
        ("must_not and see_instead are ours", []),
        ("über_x names ber_x as ASCII edges see it", ["ber_x"]),
        ("twice twice_named twice_named", ["twice_named"]),
    ],
)
def test_facets(spark, body, want):
    assert value(spark, T.facets(F.col("b")), b=body) == want


def test_facets_are_cut_alphabetically(spark):
    body = " ".join(f"name_{i:02d}" for i in reversed(range(40)))
    assert value(spark, T.facets(F.col("b")), b=body) == [f"name_{i:02d}" for i in range(32)]


def test_touches_are_not_held_against_the_vocabulary(spark):
    assert value(spark, T.normalise_facet(F.col("b")), b=" :Must_Not, ") == "must_not"
    assert value(spark, T.normalise_facet(F.col("b")), b="1.2") is None


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("cancellation", "cancel"), ("cancellable", "cancel"), ("electrical", "electr"), ("adjustment", "adjust"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("sky", "sky"), ("is", "is"), ("über", "über")])
def test_stem(word, want):
    assert stem(word) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [("// decision: auth/token-ttl", ["auth/token-ttl"]), ("# Decision :  A/b", ["a/b"]), ("x decision: a/b decision:c/d", ["a/b", "c/d"]), ("decision:ignore decision: a/b", []), ("no label", [])],
)
def test_labels(spark, line, want):
    assert value(spark, T.label_ids(F.col("b")), b=line) == want


def test_small_rules(spark):
    assert value(spark, T.file_kind(F.col("b")), b="docs/A.MD") == "doc" and value(spark, T.file_kind(F.col("b")), b="a.go") == "code"
    assert value(spark, T.line_range_hash(F.col("b"), F.lit(2), F.lit(3)), b="a\nb\nc\nd") == hashlib.sha256(b"b\nc").hexdigest()
    assert value(spark, T.line_range_hash(F.col("b"), F.lit(2), F.lit(9)), b="a\nb") is None
    assert tuple(value(spark, T.source_range(F.col("b")), b="a/b.go:10-14")) == ("a/b.go", 10, 14)
    assert tuple(value(spark, T.source_range(F.col("b")), b="f:7")) == ("f", 7, 7) and value(spark, T.source_range(F.col("b")), b="f") is None
    assert value(spark, T.rewrite_id(F.col("b"), F.lit("a/b"), F.lit("c/d")), b="a/b, xa/b a/b-c (a/b)") == "c/d, xa/b a/b-c (c/d)"
    assert value(spark, T.excerpt(F.col("b")), b=" é" + "é" * 100 + "\nmore") == "é" * 70 + "…"
    grew = lambda o, n: value(spark, T.grew(F.col("o"), F.col("n")), o=o, n=n)
    assert grew("x" * 100, "x" * 400) and not grew("", "x" * 900) and not grew("x" * 100, "x" * 399) and not grew("x" * 1000, "x" * 1400)


@pytest.mark.parametrize(("a", "b", "want"), [("must", "must_not", True), ("should", "should_not", True), ("may", "must_not", True), ("must", "should", False), ("must_not", "should_not", False), ("must", None, False), ("odd", "must_not", False)])
def test_modality(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a string, b string")
    assert row.select(T.modality_conflict(F.col("a"), F.col("b")).alias("x")).first().x is want


@pytest.mark.parametrize(
    ("sim", "shared", "cov", "terms", "want"),
    [(0.9, 0, 0.0, 9, "duplicate"), (0.83, 1, 0.0, 9, "duplicate"), (0.83, 0, 0.9, 9, "related"), (None, 2, 0.34, 9, "duplicate"), (None, 0, 0.7, 9, "duplicate"), (None, 0, 0.7, 3, "weak"), (0.6, 0, 0.7, 9, "related"), (0.72, 0, 0.0, 9, "related"), (None, 1, 0.0, 9, "related"), (None, 0, 0.3, 9, "weak")],
)
def test_verdicts(spark, sim, shared, cov, terms, want):
    row = spark.createDataFrame([(sim, shared, cov, terms)], "s double, f int, c double, t int")
    assert row.select(T.verdict(F.col("s"), F.col("f"), F.col("c"), F.col("t")).alias("x")).first().x == want


def test_cosine(spark):
    c = lambda a, b: spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(T.cosine(F.col("a"), F.col("b")).alias("x")).first().x
    assert c([1.0, 0.0], [0.0, 1.0]) == 0 and abs(c([1.0, 1.0], [2.0, 2.0]) - 1) < 1e-12
    assert c([1.0], [1.0, 0.0]) == 0 and c([], []) == 0 and c([0.0], [1.0]) == 0
