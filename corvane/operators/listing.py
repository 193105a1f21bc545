"""Lists, lookups and briefs over statements, and their relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import text as T
from corvane.operators import trace


def listed(statements: DataFrame, namespace: str | None = None, kind: str | None = None, status: str | None = None, tag: str | None = None) -> DataFrame:
    out = statements.filter(T.in_namespace(F.col("namespace"), namespace))
    for column, value in (("kind", kind), ("status", status)):
        out = out.filter(F.col(column) == value) if value else out
    return out.filter(F.array_contains("tags", tag)) if tag else out


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy("namespace", "id")


def statuses(records: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """records with embedding_status under one model."""
    e = embeddings.filter(F.col("model") == model).select("source_kind", "full_id", F.col("source_hash").alias("_h"))
    return records.join(e, ["source_kind", "full_id"], "left").withColumn("embedding_status", T.embedding_status(F.col("_h"), F.col("body"))).drop("_h")


def needs_embedding(records: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    return statuses(records, embeddings, model).filter((F.col("embedding_status") != "fresh") & (T.searchable(F.col("status")) | (F.col("source_kind") == "rejection")))


def unreferenced(statements: DataFrame, edges: DataFrame, refs: DataFrame, direct: bool = False) -> DataFrame:
    """Searchable statements without a code label; nothing at all where no code label exists. Unless direct, abstract ones and those covered by their refiners are left out."""
    counts = trace.reference_counts(refs).filter("code_refs > 0")
    used = counts.agg((F.count(F.lit(1)) > 0).alias("_used"))
    out = statements.filter(T.searchable(F.col("status"))).join(counts.select("full_id"), "full_id", "left_anti")
    if not direct:
        cover = trace.refiner_coverage(statements, edges, refs).filter("covered").select("full_id")
        out = out.filter(~F.col("abstract")).join(cover, "full_id", "left_anti")
    return out.crossJoin(F.broadcast(used)).filter("_used").drop("_used")  # one row


def get(full_id: str, statements: DataFrame, rejections: DataFrame, embeddings: DataFrame, model: str, refs: DataFrame, edges: DataFrame) -> DataFrame:
    """One record with its embedding status, label counts and inbound edges; a rejection if no statement has the id."""
    one = F.col("full_id") == full_id
    s = statements.filter(one).select(F.lit("statement").alias("source_kind"), "full_id", "namespace", "kind", "modality", "status", "abstract", "body")
    r = rejections.filter(one).select(F.lit("rejection").alias("source_kind"), "full_id", "namespace", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("modality"), F.lit(None).cast("string").alias("status"), F.lit(False).alias("abstract"), "body")
    both = s.unionByName(r).withColumn("_i", F.row_number().over(Window.partitionBy("full_id").orderBy(F.desc("source_kind")))).filter("_i = 1").drop("_i")
    counts = trace.reference_counts(refs.filter(one))
    into = edges.filter(F.col("to_id") == full_id).groupBy(F.col("to_id").alias("full_id")).agg(F.array_sort(F.collect_set(F.concat_ws(" ", "type", "from_id"))).alias("inbound"))
    out = statuses(both, embeddings.filter(one), model).join(counts, "full_id", "left").join(into, "full_id", "left")
    return out.withColumn("code_refs", F.coalesce("code_refs", F.lit(0))).withColumn("doc_mentions", F.coalesce("doc_mentions", F.lit(0))).withColumn("inbound", F.coalesce("inbound", F.array().cast("array<string>")))


def challenged(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """full_id of records that a proposal conflicts with or would supersede."""
    proposed = statements.filter(F.col("status") == "proposed").select(F.col("full_id").alias("from_id"))
    return edges.filter(F.col("type").isin("conflicts_with", "supersedes")).join(proposed, "from_id", "left_semi").select(F.col("to_id").alias("full_id")).distinct()


def dangling_pointers(statements: DataFrame, rejections: DataFrame) -> DataFrame:
    """Rejections that point at no statement."""
    p = rejections.filter(F.col("see_instead").isNotNull() & (F.col("see_instead") != "")).select("full_id", "see_instead")
    return p.join(statements.select(F.col("full_id").alias("see_instead")), "see_instead", "left_anti").select("full_id", "see_instead")


def inbound(edges: DataFrame, to_ids: DataFrame) -> DataFrame:
    return edges.join(to_ids.select(F.col("full_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", "type", "unconfirmed")


def rejected_alternatives(rejections: DataFrame, statements: DataFrame) -> DataFrame:
    """full_id of a statement and the alternatives rejected in its favour."""
    r = rejections.select(F.col("see_instead").alias("full_id"), F.col("full_id").alias("alternative"))
    return r.join(statements.select("full_id"), "full_id", "left_semi").groupBy("full_id").agg(F.array_sort(F.collect_list("alternative")).alias("alternatives"))


def unconfirmed(edges: DataFrame, statements: DataFrame, namespace: str | None = None) -> DataFrame:
    own = statements.filter(T.in_namespace(F.col("namespace"), namespace)).select(F.col("full_id").alias("from_id"))
    return edges.filter("unconfirmed").join(own, "from_id", "left_semi").select("from_id", "to_id", "type")


def brief(statements: DataFrame, rejections: DataFrame, edges: DataFrame, namespace: str | None = None, cap: int = C.BRIEF_CAP) -> DataFrame:
    """section, pos, full_id, excerpt, challenged, omitted: rules, the parents of the rules shown, rejections; omitted is what the cap left out of the section."""
    def section(df: DataFrame, name: str, order: list) -> DataFrame:
        whole = df.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("omitted"))
        top = df.orderBy(*order).limit(cap)
        top = top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # a page
        return top.crossJoin(F.broadcast(whole)).select(F.lit(name).alias("section"), "pos", "full_id", "excerpt", "omitted")

    rules = statements.filter(T.searchable(F.col("status")) & F.col("modality").isin("must", "must_not") & T.in_namespace(F.col("namespace"), namespace))
    rules = rules.select("full_id", T.excerpt(F.col("body")).alias("excerpt"), F.when(F.col("modality") == "must_not", 0).otherwise(1).alias("_o"))
    shown = section(rules, "rules", [F.col("_o"), F.col("full_id")])
    page = F.broadcast(shown.select("full_id"))
    up = edges.filter(F.col("type").isin("refines", "depends_on")).join(page.withColumnRenamed("full_id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("full_id")).distinct().join(page, "full_id", "left_anti")
    parents = section(up.join(statements.select("full_id", T.excerpt(F.col("body")).alias("excerpt")), "full_id", "left"), "parents", [F.col("full_id")])
    refused = section(rejections.filter(T.in_namespace(F.col("namespace"), namespace)).select("full_id", T.excerpt(F.col("body")).alias("excerpt")), "rejections", [F.col("full_id")])
    marks = challenged(statements, edges).withColumn("_c", F.lit(True))
    return shown.unionByName(parents).unionByName(refused).join(marks, "full_id", "left").select("section", "pos", "full_id", "excerpt", F.coalesce("_c", F.lit(False)).alias("challenged"), "omitted")


def coverage(records: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """total, fresh, stale, missing of what search can rank."""
    live = records.filter(T.searchable(F.col("status")) | (F.col("source_kind") == "rejection"))
    s = F.col("embedding_status")
    return statuses(live, embeddings, model).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == x).alias(x) for x in ("fresh", "stale", "missing")])


def open_wording(statements: DataFrame, clearances: DataFrame, scores: DataFrame, least: float = C.OPEN_WORDING_WARN) -> DataFrame:
    """full_id, score of statements that read as open wording, best first; a dismissal holds while the body is unchanged."""
    h = statements.filter(T.searchable(F.col("status"))).select("full_id", "namespace", "id", F.sha2("body", 256).alias("body_hash"))
    rest = h.join(clearances.select(F.col("id").alias("full_id"), "body_hash"), ["full_id", "body_hash"], "left_anti")
    return rest.join(scores, "body_hash").filter(F.col("score") >= least).orderBy(F.desc("score"), "namespace", "id").select("full_id", "score")


def models(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("model", "dims").agg(F.count(F.lit(1)).alias("n"))


def staleness(statements: DataFrame, files: DataFrame) -> DataFrame:
    """full_id, stale of statements with a stored hash of source lines, against files (file, text): a changed, missing or too short source is stale; without a hash nothing is said."""
    own = statements.filter(F.col("source_hash").isNotNull() & F.col("source_file").isNotNull()).select("full_id", F.col("source_file").alias("file"), "line_start", "line_end", "source_hash")
    now = T.line_range_hash(F.col("text"), F.col("line_start"), F.col("line_end"))
    return own.join(files, "file", "left").select("full_id", F.coalesce(now != F.col("source_hash"), F.lit(True)).alias("stale"))
