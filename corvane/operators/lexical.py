"""Tokens, document frequencies, the saturation filter and BM25 over phrases.

Two corpora, statements (namespace, body, tags) and rejections (namespace, body),
each with its own frequencies over all its rows, retired ones included; hits are
filtered afterwards. A draft's fields are phrases, joined by OR; the draft is one
request, so its phrases are literals that are counted inside each row: one pass
gives all frequencies, a second one the scores, and no token is shuffled. Arrays are
exploded by the outer forms, as Spark infers a filter below the inner ones that
makes the tokens a second time. postings() and document_frequency() build the inverted tables
for callers that ask often.
"""

from __future__ import annotations

import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import text as T
from corvane.functions.porter import stem, stem_column

GAP = ""  # stands between columns, so that no phrase crosses them
OTHER = "\u0001"  # stands for a word that no stem of the draft has


def tokenised(records: DataFrame) -> DataFrame:
    """records with terms (array, columns parted by GAP) and dl, the number of tokens."""
    parts = [T.tokens(F.col("namespace")), T.tokens(F.col("body")), T.tokens(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " \u0000 "))]
    gap = F.array(F.lit(GAP))
    return records.withColumn("terms", F.concat(parts[0], gap, parts[1], gap, parts[2])).withColumn("dl", F.size("terms") - 2)


def forms(tokenised_: DataFrame, stems: list[str]) -> dict[str, str]:
    """The corpus's words that have one of the stems, each with its stem.

    A stem and its words share all but the stem's last two characters, so only words
    with such a beginning are made distinct and stemmed; suffixes are a fixed list,
    so a draft's stems have a bounded number of forms, whatever the corpus.
    """
    begin = sorted({s[: max(1, len(s) - 2)] for s in stems})
    if not begin:
        return {}
    sizes = {}
    for x in begin:
        sizes.setdefault(len(x), []).append(x)
    alike = lambda w: reduce(operator.or_, [F.substring(w, 1, n).isin(xs) for n, xs in sizes.items()])
    words = tokenised_.select(F.explode_outer(F.array_distinct(F.filter("terms", alike))).alias("w")).distinct()
    return {r.w: r.s for r in words.select("w", stem_column("w").alias("s")).filter(F.col("s").isin(sorted(set(stems)))).collect()}


def stemmed_for(tokenised_: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """tokenised_ with the stems of a draft in place of their forms and OTHER for all other words; tokens stay where they are."""
    found = forms(tokenised_, [w for p in phrases for w in p])
    if not found:
        return tokenised_.withColumn("terms", F.transform("terms", lambda w: F.lit(OTHER)))
    stem_of = F.create_map(*[F.lit(x) for pair in sorted(found.items()) for x in pair])
    return tokenised_.withColumn("terms", F.transform("terms", lambda w: F.when(w.isin(sorted(found)), stem_of[w]).otherwise(OTHER)))


def postings(tokenised_: DataFrame) -> DataFrame:
    """source_kind, full_id, term, tf, positions."""
    rows = tokenised_.select("source_kind", "full_id", F.posexplode_outer("terms").alias("pos", "term")).filter(F.col("term") != GAP)
    return rows.groupBy("source_kind", "full_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def document_frequency(tokenised_: DataFrame) -> DataFrame:
    """source_kind, term, df: rows that hold the term."""
    rows = tokenised_.select("source_kind", F.explode_outer(F.array_distinct("terms")).alias("term")).filter(F.col("term") != GAP)
    return rows.groupBy("source_kind", "term").agg(F.count(F.lit(1)).alias("df"))


def draft_phrases(spark: SparkSession, draft: str, stemmed: bool = False) -> list[list[str]]:
    """The tokens of each field of a draft, fields in order."""
    f = spark.createDataFrame([(draft,)], "t string").select(F.posexplode(T.fields(F.col("t"))).alias("p", "f")).select("p", T.tokens(F.col("f")).alias("w"))
    return [[stem(x) if stemmed else x for x in r.w if x] for r in f.orderBy("p").collect()]


def occurrences(phrase: list[str]) -> Column:
    """How often a phrase of several tokens stands in terms."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - len(phrase) + 1, F.lit(1)))
    found = F.size(F.filter(starts, lambda i: F.slice("terms", i, len(phrase)) == F.array(*[F.lit(w) for w in phrase])))
    return F.when(F.array_contains("terms", phrase[0]), found).otherwise(0)


def matches(tokenised_: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """source_kind, full_id, dl, found: of a draft's tokens and longer phrases (their tokens joined by spaces), those in the row, as (term, tf)."""
    words = sorted({w for p in phrases for w in p})
    longer = sorted({tuple(p) for p in phrases if len(p) > 1})
    rows = tokenised_.withColumn("_held", F.filter("terms", lambda w: w.isin(words)) if words else F.array().cast("array<string>"))
    single = F.transform(F.array_distinct("_held"), lambda w: F.struct(w.alias("term"), F.size(F.filter("_held", lambda x: x == w)).alias("tf")))
    several = F.array(*[F.struct(F.lit(" ".join(p)).alias("term"), occurrences(list(p)).alias("tf")) for p in longer])
    found = F.concat(single, F.filter(several, lambda x: x["tf"] > 0)) if longer else single
    return rows.select("source_kind", "full_id", "dl", found.alias("found"))


def corpus_counts(tokenised_: DataFrame, phrases: list[list[str]]) -> dict[str, dict]:
    """Per source_kind: n rows, mean length, rows holding each token and each phrase of a draft; one pass, one row per term of the draft."""
    every = F.struct(F.lit(GAP).alias("term"), F.col("dl").alias("tf"))  # stands for the row itself
    rows = matches(tokenised_, phrases).select("source_kind", F.explode_outer(F.concat(F.array(every), "found")).alias("x"))
    out: dict[str, dict] = {}
    for r in rows.groupBy("source_kind", F.col("x.term").alias("term")).agg(F.count(F.lit(1)).alias("n"), F.avg("x.tf").alias("mean")).collect():
        c = out.setdefault(r.source_kind, {"n": 0, "avgdl": 0.0, "token": {}})
        if r.term == GAP:
            c |= {"n": r.n, "avgdl": r.mean}
        else:
            c["token"][r.term] = r.n
    for c in out.values():
        c["phrase"] = [c["token"].get(" ".join(p), 0) if p else 0 for p in phrases]
    return out


def kept_fields(phrases: list[list[str]], counts: dict) -> list[int]:
    """Fields that still tell rows apart: one is dropped when all its tokens are in more than half the rows; all stay if none would."""
    if counts["n"] < C.DF_FILTER_ROWS:
        return list(range(len(phrases)))
    kept = [i for i, p in enumerate(phrases) if not p or any(counts["token"].get(w, 0) * 2 <= counts["n"] for w in p)]
    return kept or list(range(len(phrases)))


def bm25(tokenised_: DataFrame, phrases: list[list[str]], counts: dict[str, dict]) -> DataFrame:
    """source_kind, full_id, score (higher is better) of rows that hold a kept phrase."""
    idf = lambda c, i: max(math.log((c["n"] - c["phrase"][i] + 0.5) / (c["phrase"][i] + 0.5)), C.BM25_LEAST_IDF)
    asked = [(kind, " ".join(phrases[i]), idf(c, i), c["avgdl"]) for kind, c in sorted(counts.items()) for i in kept_fields(phrases, c) if phrases[i]]
    # a field named twice counts twice; one row per phrase of the draft
    terms = tokenised_.sparkSession.createDataFrame(asked, "source_kind string, term string, idf double, avgdl double").groupBy("source_kind", "term", "avgdl").agg(F.sum("idf").alias("idf"))
    found = matches(tokenised_, phrases).select("source_kind", "full_id", "dl", F.inline_outer("found")).join(F.broadcast(terms), ["source_kind", "term"])
    weight = F.col("idf") * F.col("tf") * (C.BM25_K1 + 1) / (F.col("tf") + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("dl") / F.col("avgdl")))
    return found.groupBy("source_kind", "full_id").agg(F.sum(weight).alias("score"))
