"""Line dedup with DataFrame functions only.

Lines are normalised, hashed and counted by document; the lines of a key that
enough documents hold go everywhere but in the largest doc_id that holds it.
Long keys are counted from one row per (row, key), made distinct inside the row,
so that the count and the maximum combine before the shuffle and a line found in
every document costs one row per task. Where a doc_id has several rows, what they
counted too often is found from those rows alone, distinct by (key, doc_id), and
taken off. What is frequent (one row a
key) is joined back over SALT parts of each key, so that such a line's rows spread.

Defined cases: null text is one empty line; a row with a null doc_id takes part
in the counts, loses its lines like any other and never is the keeper unless
nothing but null ids hold the key; rows that share a doc_id, repeated or not, count
as one document, rows without one as one each, and both lose their own lines only (they are told apart by
their texts); an empty table gives an empty one; other columns are ignored
(line_report) or kept (dedup_lines), where input columns named n_lines or n_dropped
are replaced by the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
SALT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("row"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))


def _hash(key: Column) -> Column:
    """128 bits, so that two keys never meet in practice."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def frequent_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """a, b (the key's hash), n_docs, keeper (the largest doc_id) of keys in min_docs documents or more."""
    keys = F.filter(F.transform("lines", _key), lambda k: F.length(k) >= min_chars)
    held = _lines(docs).select("doc_id", F.explode(F.array_distinct(F.transform(keys, _hash))).alias("h"))
    counts = held.groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b"))
    found = counts.agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= min_docs)
    again = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id")
    if again.isEmpty():
        return found
    rows = _lines(docs).select("doc_id", F.array_distinct(F.transform(keys, _hash)).alias("hs")).join(again, F.col("doc_id") == F.col("_id"), "left_semi")
    twice = rows.select("doc_id", F.explode("hs").alias("h")).groupBy("doc_id", F.col("h.a").alias("a"), F.col("h.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    over = twice.groupBy("a", "b").agg(F.sum(F.col("n") - 1).alias("over"))
    right = found.join(over, ["a", "b"], "left").withColumn("n_docs", F.col("n_docs") - F.coalesce("over", F.lit(0)))
    return right.drop("over").filter(F.col("n_docs") >= min_docs)


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, row (the text's hash) and the positions (from 0) of its lines to drop; documents that lose none have no row."""
    held = (
        _lines(docs)
        .select("doc_id", "row", F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "row", "pos", _key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "row", "pos", _hash(F.col("key")).alias("h"))
        .select("doc_id", "row", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"), F.pmod(F.hash("row", "pos"), F.lit(SALT)).alias("salt"))
    )
    frequent = frequent_lines(docs, min_chars, min_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    hit = held.join(frequent, ["a", "b", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return hit.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("dropped"))


def _unlike(name: str, docs: DataFrame) -> str:
    """name, longer where docs has it."""
    while name in docs.columns:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep_names: bool = False) -> DataFrame:
    """Every column of docs with text rebuilt from the lines kept, and n_lines, n_dropped; with keep_names the columns of docs alone, whatever their names."""
    lines, drop = _unlike("_lines", docs), _unlike("_dropped", docs)
    out = [F.col(f"d.`{c}`") for c in docs.columns if c != "text"]
    drops = dropped_lines(docs, min_chars, min_docs)
    joined = docs.alias("d").join(drops.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.xxhash64("d.text") == F.col("x.row")), "left")
    split = joined.select(*out, F.split(F.coalesce("d.text", F.lit("")), "\n").alias(lines), F.coalesce("x.dropped", F.array().cast("array<int>")).alias(drop))
    last = F.size(lines) - 1
    kept = F.transform(F.array_except(F.sequence(F.lit(0), last), drop), lambda i: F.get(lines, i))
    text = F.when(F.size(drop) == 0, F.array_join(lines, "\n")).otherwise(F.array_join(kept, "\n"))
    if keep_names:
        return split.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return split.select(*[f"`{c}`" for c in docs.columns if c not in ("text", "n_lines", "n_dropped")], text.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_dropped"))


def line_report(docs: DataFrame) -> DataFrame:
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


LINE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
