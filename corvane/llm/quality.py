"""Quality rules with thresholds learned from the corpus, by DataFrame functions only.

Each document gets integer measures. Each measure of each (language, source) has
a quantile sketch: counts by bucket, buckets at most one sixteenth wide (exact up
to 15), a relative-error histogram. Sketches merge by adding counts, so they
combine before the shuffle, a hot source costs a few hundred rows per task, and
the thresholds are the same on every run. A group's upper fence is
q75 + 3 * max(q75 - q25, floor) (the lower one alike); groups of fewer than
MIN_GROUP documents take the fence of their language, then of the whole corpus,
whose sketches are sums of the groups'. Documents are joined to the fences of
their group and kept if they stand inside all of them and pass the base rules.

Defined cases: null text has no words and fails the base rules; null lang or
source is a group of its own; an empty table gives an empty one; repeated rows
are judged alike and counted each; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.scratch import cut

SPACE = r"[\x20\x09-\x0D]+"
MIN_GROUP = 200
FEW = 24
#: measure: (least spread, whether the upper side is fenced, whether the lower side is)
FENCES = {"symbol_rate": (15, True, False), "dup_line_rate": (150, True, False), "repeat_rate": (100, True, False), "word_len": (40, True, True), "caps_rate": (60, True, False)}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the base rules with the measures of FENCES."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("_row"), text.alias("_t"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("_w"))
    hashed = split.select(
        "doc_id", "lang", "source", "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[^A-Z]+", "")).cast("long").alias("n_caps"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_x"),
    )
    span = F.sequence(F.lit(0), F.size("_x") - 3)
    windows = F.when(F.size("_x") >= 3, F.transform(span, lambda i: F.xxhash64(F.get("_x", i), F.get("_x", i + 1), F.get("_x", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    keep = ["doc_id", "lang", "source", "_row", "n_words", "word_chars", "n_symbols", "n_caps"]
    lines = [F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines")]
    # A text without repeated windows, told by a distinct count, needs no more; else the repeated hashes are sought
    # in the windows (few of them), or hash and position are sorted together (many of them): never more than n log n.
    step = hashed.select(*keep, *lines, windows.alias("_h"))
    step = step.select(*keep, "n_lines", "n_dup_lines", "_h", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")).otherwise(F.array().cast("array<bigint>")).alias("_s"))
    again = F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (x == F.get("_s", F.greatest(i - 1, F.lit(0))))))
    step = step.select(*keep, "n_lines", "n_dup_lines", "_h", again.alias("_a"))
    many = F.size("_a") > FEW
    pairs = F.when(many, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    step = step.select(*keep, "n_lines", "n_dup_lines", "_h", "_a", pairs.alias("_p"))
    same = lambda p, j: F.get("_p", j)["h"] == p["h"]
    at = F.when(F.size("_a") == 0, F.array().cast("array<int>")).when(
        many, F.transform(F.filter("_p", lambda p, i: F.coalesce(same(p, F.greatest(i - 1, F.lit(0))) & (i > 0), F.lit(False)) | F.coalesce(same(p, i + 1), F.lit(False))), lambda p: p["i"])
    ).otherwise(F.filter(F.transform("_h", lambda h, i: F.when(F.array_contains("_a", h), i)), lambda i: i.isNotNull()))
    step = step.select(*keep, "n_lines", "n_dup_lines", at.alias("_at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_at", lambda i: F.array(i, i + 1, i + 2)))))
    step = step.select(*keep, "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))
    rate = lambda a, b: F.expr(f"{a} * 1000 div greatest({b}, 1)")
    return step.select(
        "doc_id", "lang", "source", "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        rate("n_symbols", "word_chars").alias("symbol_rate"), rate("n_dup_lines", "n_lines").alias("dup_line_rate"), rate("n_repeat_words", "n_words").alias("repeat_rate"),
        F.expr("word_chars * 100 div greatest(n_words, 1)").alias("word_len"), rate("n_caps", "word_chars").alias("caps_rate"),
    )


def bucket(x: Column) -> Column:
    """x >= 0 as the lowest value of its bucket: 5 significant bits."""
    low = F.greatest(F.length(F.bin(x)) - 5, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", x, low), low)


def sketches(measures: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: mergeable by adding n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in FENCES]))
    return measures.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.measure", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, q25, q75, size from sketches, merged to the columns of by."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    run = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("size", F.sum("n").over(group))
    q = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("size") * k, F.col("bucket")))
    return run.groupBy(*by, "measure").agg(q(1).alias("q25"), q(3).alias("q75"), F.max("size").alias("size"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and one struct (lo, hi) per measure, from the smallest group that is large enough."""
    own = quantiles(sketch, ["lang", "source"])
    lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("_lang"), F.col("measure").alias("_m"), F.col("q25").alias("l25"), F.col("q75").alias("l75"), F.col("size").alias("lsize"))
    whole = quantiles(sketch, []).select(F.col("measure").alias("_n"), F.col("q25").alias("w25"), F.col("q75").alias("w75"))
    all_ = own.join(lang, own["lang"].eqNullSafe(lang["_lang"]) & (own["measure"] == lang["_m"])).join(whole, own["measure"] == whole["_n"])
    pick = lambda a, b, c: F.when(F.col("size") >= MIN_GROUP, F.col(a)).when(F.col("lsize") >= MIN_GROUP, F.col(b)).otherwise(F.col(c))
    chosen = all_.select("lang", "source", "measure", pick("q25", "l25", "w25").alias("q25"), pick("q75", "l75", "w75").alias("q75"))
    ends = []
    for m, (least, up, down) in FENCES.items():
        is_m = F.col("measure") == m
        spread = 3 * F.greatest(F.col("q75") - F.col("q25"), F.lit(least))
        if up:
            ends.append(F.max(F.when(is_m, F.col("q75") + spread)).alias(f"{m}_hi"))
        if down:
            ends.append(F.max(F.when(is_m, F.col("q25") - spread)).alias(f"{m}_lo"))
    return chosen.groupBy("lang", "source").agg(*ends)


def judged(docs: DataFrame) -> DataFrame:
    """Measures of every document, with base_failed and kept. Texts are measured once, into a narrow shared table."""
    measures = cut(measured(docs), "quality")
    f = fences(sketches(measures)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = measures.join(f, measures["lang"].eqNullSafe(f["_lang"]) & measures["source"].eqNullSafe(f["_source"]), "left")
    inside = [F.col(m) <= F.col(f"{m}_hi") for m, (_, up, _d) in FENCES.items() if up] + [F.col(m) >= F.col(f"{m}_lo") for m, (_, _u, down) in FENCES.items() if down]
    good = reduce(lambda a, b: a & b, inside)
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(True))).drop("_lang", "_source")


def report(docs: DataFrame) -> DataFrame:
    done = judged(docs.select("doc_id", "lang", "source", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *FENCES)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept; rows that share a doc_id are told apart by text, language and source."""
    good = judged(docs.select("doc_id", "lang", "source", "text")).filter("kept").select(F.col("doc_id").alias("_id"), "_row", F.col("lang").alias("_lang"), F.col("source").alias("_source")).distinct()
    same = docs["doc_id"].eqNullSafe(good["_id"]) & (F.xxhash64(docs["text"]) == good["_row"]) & docs["lang"].eqNullSafe(good["_lang"]) & docs["source"].eqNullSafe(good["_source"])
    return docs.join(good, same, "left_semi")


QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
b AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_caps,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
m AS (
  SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols * 1000 // greatest(word_chars, 1) AS symbol_rate, (len(l) - len(list_distinct(l))) * 1000 // greatest(len(l), 1) AS dup_line_rate,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS word_len, n_caps * 1000 // greatest(word_chars, 1) AS caps_rate
  FROM b),
v AS (SELECT lang, source, measure, (value >> greatest(length(bin(value)) - 5, 0)) << greatest(length(bin(value)) - 5, 0) AS bucket
      FROM (UNPIVOT (SELECT lang, source, symbol_rate::BIGINT AS symbol_rate, dup_line_rate::BIGINT AS dup_line_rate, repeat_rate::BIGINT AS repeat_rate, word_len::BIGINT AS word_len, caps_rate::BIGINT AS caps_rate FROM m)
            ON symbol_rate, dup_line_rate, repeat_rate, word_len, caps_rate INTO NAME measure VALUE value)),
q1 AS (SELECT lang, source, measure, quantile_disc(bucket, 0.25) AS q25, quantile_disc(bucket, 0.75) AS q75, count(*) AS n FROM v GROUP BY ALL),
q2 AS (SELECT lang, measure, quantile_disc(bucket, 0.25) AS q25, quantile_disc(bucket, 0.75) AS q75, count(*) AS n FROM v GROUP BY ALL),
q3 AS (SELECT measure, quantile_disc(bucket, 0.25) AS q25, quantile_disc(bucket, 0.75) AS q75 FROM v GROUP BY ALL),
f AS (
  SELECT q1.lang, q1.source, measure, CASE WHEN q1.n >= 200 THEN q1.q25 WHEN q2.n >= 200 THEN q2.q25 ELSE q3.q25 END AS a,
         CASE WHEN q1.n >= 200 THEN q1.q75 WHEN q2.n >= 200 THEN q2.q75 ELSE q3.q75 END AS z,
         3 * greatest(z - a, CASE measure WHEN 'symbol_rate' THEN 15 WHEN 'dup_line_rate' THEN 150 WHEN 'repeat_rate' THEN 100 WHEN 'word_len' THEN 40 ELSE 60 END) AS gap
  FROM q1 JOIN q2 USING (lang, measure) JOIN q3 USING (measure)),
p AS (PIVOT (SELECT lang, source, measure, z + gap AS hi, a - gap AS lo FROM f) ON measure IN ('symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_len', 'caps_rate') USING max(hi) AS hi, max(lo) AS lo)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND symbol_rate <= symbol_rate_hi AND dup_line_rate <= dup_line_rate_hi AND repeat_rate <= repeat_rate_hi
       AND word_len <= word_len_hi AND word_len >= word_len_lo AND caps_rate <= caps_rate_hi AS kept,
       symbol_rate, dup_line_rate, repeat_rate, word_len, caps_rate
FROM m JOIN p USING (lang, source)
"""
