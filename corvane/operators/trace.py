"""Labels in source text: scan, classification, near misses, coverage by refiners, file search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import text as T


def scan(lines: DataFrame, marker: str = C.MARKER) -> DataFrame:
    """full_id, file, line, kind of every label in lines (file, line, text)."""
    return lines.select(F.explode(T.label_ids(F.col("text"), marker)).alias("full_id"), "file", "line", T.file_kind(F.col("file")).alias("kind")).dropDuplicates(["full_id", "file", "line", "kind"])


def classified(refs: DataFrame, statements: DataFrame, rejections: DataFrame) -> DataFrame:
    """refs with class: the statement's first (abstract before its status), else rejected, else dangling."""
    s = statements.select("full_id", F.when(F.col("abstract"), "abstract").when(F.col("status").isin("superseded", "deprecated"), "retired").otherwise(F.col("status")).alias("_c"))
    r = rejections.select("full_id", F.lit(True).alias("_r")).distinct()
    return refs.join(s, "full_id", "left").join(r, "full_id", "left").withColumn("class", F.coalesce("_c", F.when(F.col("_r"), "rejected"), F.lit("dangling"))).drop("_c", "_r")


def contradicting(classes: DataFrame) -> DataFrame:
    """Code labels on decisions that cannot be in force."""
    return classes.filter(F.col("class").isin("retired", "rejected", "abstract") & (F.col("kind") != "doc"))


def _variants(name: Column, deletions: int) -> Column:
    """Every string that up to `deletions` deletions make of name, itself included."""
    out = F.array(name)
    for _ in range(deletions):
        longer = F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
        out = F.array_distinct(F.concat(out, longer))
    return out


def near_misses(classes: DataFrame, statements: DataFrame, rejections: DataFrame) -> DataFrame:
    """full_id (dangling), file, line, nearest, distance: the closest known id within EDIT_DISTANCE edits.

    Two ids within d edits share a string that d deletions make of each, so candidates come from an equi-join on those
    strings' hashes, never from a cross join; ids as long as no known one, give or take d, are not spread. Ties keep the
    first known id: statements by namespace and id, then rejections.
    """
    known = statements.select("full_id", F.lit(0).alias("_o"), "namespace", "id").unionByName(rejections.select("full_id", F.lit(1).alias("_o"), F.col("namespace"), F.col("full_id").alias("id")))
    lost = classes.filter(F.col("class") == "dangling").select("full_id").distinct()
    size = lambda d: d.select(F.length("full_id").alias("_n")).distinct()
    near = F.explode(F.sequence(F.col("_n") - C.EDIT_DISTANCE, F.col("_n") + C.EDIT_DISTANCE)).alias("_n")
    alike = lambda d, other: d.join(F.broadcast(size(other).select(near).distinct()), F.length("full_id") == F.col("_n"), "left_semi")  # noqa: E731  one row a length
    variants = F.explode(F.transform(_variants(F.col("full_id"), C.EDIT_DISTANCE), lambda s: F.xxhash64(s))).alias("v")
    a = alike(lost, known).select(F.col("full_id").alias("lost"), variants)
    b = known.select(F.col("full_id").alias("nearest"), "_o", "namespace", "id", variants)
    # what explode makes is far more than Spark expects of it, so neither side may be taken for one to broadcast
    pairs = a.hint("merge").join(b, "v").withColumn("distance", F.levenshtein("lost", "nearest", C.EDIT_DISTANCE)).filter("distance >= 0")
    best = pairs.groupBy("lost").agg(F.min(F.struct("distance", "_o", "namespace", "id", "nearest")).alias("_b")).select(F.col("lost").alias("full_id"), "_b.nearest", "_b.distance")
    return classes.filter(F.col("class") == "dangling").join(best, "full_id").select("full_id", "file", "line", "nearest", "distance")


def reference_counts(refs: DataFrame) -> DataFrame:
    """full_id, code_refs, doc_mentions."""
    return refs.groupBy("full_id").agg(F.count_if(F.col("kind") == "code").alias("code_refs"), F.count_if(F.col("kind") == "doc").alias("doc_mentions"))


def refiner_coverage(statements: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """full_id, refiners, covered: whether all active direct refiners have a code label of their own. One hop."""
    counts = reference_counts(refs).filter("code_refs > 0").select(F.col("full_id").alias("from_id"), F.lit(True).alias("_has"))
    active = statements.filter(F.col("status") == "active").select(F.col("full_id").alias("from_id"))
    r = edges.filter(F.col("type") == "refines").select("from_id", "to_id").distinct().join(active, "from_id", "left_semi").join(counts, "from_id", "left")
    return r.groupBy(F.col("to_id").alias("full_id")).agg(F.count(F.lit(1)).alias("refiners"), F.bool_and(F.coalesce("_has", F.lit(False))).alias("covered"))


def vocabulary_search(lines: DataFrame, body: Column, limit: int = C.SEARCH_LIMIT, skip: DataFrame | None = None) -> DataFrame:
    """file, score, matched: files (file, text) by how many of a body's search terms they hold. skip: files left out."""
    terms = F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), body)
    hits = lines.select("file", F.explode(terms).alias("term")).groupBy("file").agg(F.array_sort(F.collect_set("term")).alias("matched"))
    if skip is not None:
        hits = hits.join(skip.select("file").distinct(), "file", "left_anti")
    return hits.select("file", F.size("matched").alias("score"), "matched").orderBy(F.desc("score"), "file").limit(limit)


def trace(full_id: str, refs: DataFrame, statements: DataFrame, rejections: DataFrame) -> DataFrame:
    """The sites that label one decision, with their class."""
    return classified(refs.filter(F.col("full_id") == full_id), statements, rejections).orderBy("file", "line")


def commits_of(commits: DataFrame, full_id: str, trailer: str = "Decision") -> DataFrame:
    """sha (7), date, subject of commits whose message carries the trailer for full_id."""
    return commits.filter(F.col("message").rlike(rf"(?im)^{trailer}:[ \t]*\Q{full_id}\E[ \t]*$")).select(F.substring("sha", 1, 7).alias("sha"), "date", "subject")
