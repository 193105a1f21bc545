"""Applying a batch of operations to record tables: an ordered replay, set by set.

Every line is checked before any is applied, and one that is no operation refuses the
whole batch; so do a line too long and a batch without operations. After that a line
can only be refused for what the tables hold when its turn comes, and the others
apply. Lines take effect in the order of their numbers: a line of one key sees what
earlier lines of that key did, by a window over the key's events.

Records only come: one is there from its first good `add` on, so existence at a line
is a comparison of line numbers. Edges come and go: the events of one (from, to, type)
are what the table held, `link`, `unlink` of that type, and `unlink` of the pair, and
an edge is there when the last event before a line was a link. Its note, confirmation
and origin are those of the links since it last came.

Whether an `add` reads like a record that exists is for the caller to say (the lines
that check.duplicates_of finds), as it needs the corpus and not the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import text as T
from corvane.operators import records
from corvane.sources.shared import stored

RESULTS = ["line_no", "op", "full_id", "applied", "problem"]


@dataclass(frozen=True)
class Store:
    """The tables a batch changes. clearances: id, body_hash, note."""

    statements: DataFrame
    rejections: DataFrame
    edges: DataFrame
    verdicts: DataFrame
    clearances: DataFrame


def _known(column: str, first: DataFrame, name: str) -> DataFrame:
    """first (full_id, since) under the names that joining to column needs."""
    return first.select(F.col("full_id").alias(column), F.col("since").alias(name))


def judged(lines: DataFrame, store: Store, duplicates: DataFrame | None = None) -> DataFrame:
    """The operations of (line_no, text) with problem: why a line is refused when its turn comes. Edges are not looked at."""
    lines = lines if "o" in lines.columns else stored(records.parsed(lines), "batch-read")
    ops = stored(records.operations(lines), "batch-operations")
    if duplicates is not None:
        ops = ops.join(duplicates.select("line_no", F.lit(True).alias("_dup")), "line_no", "left").withColumn("_dup", F.coalesce("_dup", F.lit(False)) & ~F.col("duplicate_ok"))
    else:
        ops = ops.withColumn("_dup", F.lit(False))
    bad_name = F.when(~T.valid_slug(F.col("id")), "invalid id").when(~T.valid_namespace(F.col("namespace")), "invalid namespace")
    bad_kind = F.when(F.trim("kind") == "", "invalid kind")
    bad_status = F.when((F.col("status") != "") & ~F.col("status").isin(C.STATUSES), "invalid status")
    bad_modality = F.when((F.col("modality") != "") & ~F.col("modality").isin(C.MODALITIES) & ~((F.col("op") == "update") & (F.col("modality") == "none")), "invalid modality")
    ops = ops.withColumn("_bad", F.when(F.col("op") == "add", F.coalesce(bad_name, bad_kind, bad_status, bad_modality)).when(F.col("op") == "reject", bad_name).when(F.col("op") == "update", F.coalesce(bad_status, bad_modality)))
    here = store.statements.select("full_id", F.lit(0).cast("long").alias("since"))
    added = ops.filter((F.col("op") == "add") & F.col("_bad").isNull() & ~F.col("_dup")).select("full_id", F.col("line_no").alias("since"))
    first = here.unionByName(added).groupBy("full_id").agg(F.min("since").alias("since"))
    refused = store.rejections.select("full_id", F.lit(0).cast("long").alias("since"))
    ops = ops.join(_known("full_id", first, "_own"), "full_id", "left").join(_known("see_instead", first, "_see"), "see_instead", "left")
    ops = ops.join(_known("from_id", first, "_from"), "from_id", "left").join(_known("to_id", first, "_to"), "to_id", "left")
    there = lambda c: F.coalesce(F.col(c) < F.col("line_no"), F.lit(False))
    lost = (F.col("see_instead") != "") & ~there("_see")
    # of rejections the first good one stands, which what it points at decides, so they are numbered after that
    good = ops.filter((F.col("op") == "reject") & F.col("_bad").isNull() & ~lost).select("full_id", F.col("line_no").alias("since"))
    ops = ops.join(_known("full_id", refused.unionByName(good).groupBy("full_id").agg(F.min("since").alias("since")), "_no"), "full_id", "left")
    problem = (
        F.when((F.col("op") == "add") & there("_own"), "exists")
        .when((F.col("op") == "add") & F.col("_dup"), "duplicate")
        .when((F.col("op") == "reject") & there("_no"), "exists")
        .when((F.col("op") == "reject") & lost, "see_instead not found")
        .when((F.col("op") == "update") & ~there("_own"), "not found")
        .when((F.col("op") == "link") & (F.col("type") == "not_related"), "not_related is a verdict")
        .when((F.col("op") == "unlink") & (F.col("type") != "") & ~F.col("type").isin(C.EDGE_TYPES), "unknown type")
        .when(F.col("op").isin("link", "unlink", "dismiss") & ~there("_from"), "from not found")
        .when(((F.col("op") == "link") | ((F.col("op") == "dismiss") & ~F.col("open_wording"))) & ~there("_to"), "to not found")
        .when((F.col("op") == "link") & ~F.col("type").isin(C.EDGE_TYPES), "unknown type")
        .otherwise(F.col("_bad"))
    )
    return ops.withColumn("problem", F.coalesce("problem", problem)).drop("_dup", "_bad", "_own", "_see", "_from", "_to", "_no")


EDGE = ["from_id", "to_id", "type"]


def edge_events(ops: DataFrame, edges: DataFrame) -> DataFrame:
    """EDGE, line_no, comes, note, via, unconfirmed, there (just before the event): links and unlinks in order; line 0 is the table."""
    none = F.lit(None).cast("string")
    old = edges.select(*EDGE, F.lit(0).cast("long").alias("line_no"), F.lit(True).alias("comes"), "note", "via", "unconfirmed")
    good = ops.filter("problem is null")
    links = good.filter("op = 'link'").select(*EDGE, "line_no", F.lit(True).alias("comes"), F.nullif("note", F.lit("")).alias("note"), F.lit("batch").alias("via"), (~F.col("confirmed")).alias("unconfirmed"))
    cuts = good.filter("op = 'unlink'")
    gone = [F.lit(False).alias("comes"), none.alias("note"), none.alias("via"), F.lit(None).cast("boolean").alias("unconfirmed")]
    one = cuts.filter("type <> ''").select(*EDGE, "line_no", *gone)
    types = old.select(*EDGE).unionByName(links.select(*EDGE)).distinct()
    every = cuts.filter("type = ''").select("from_id", "to_id", "line_no").join(types, ["from_id", "to_id"]).select(*EDGE, "line_no", *gone)
    events = old.unionByName(links).unionByName(one).unionByName(every)
    before = Window.partitionBy(*EDGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("there", F.coalesce(F.last("comes").over(before), F.lit(False)))


def edges_after(events: DataFrame) -> DataFrame:
    """The edges that are there after all events: the links since each last came, as one."""
    run = Window.partitionBy(*EDGE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("_run", F.count_if(~F.col("comes")).over(run))
    last = numbered.withColumn("_last", F.max("_run").over(Window.partitionBy(*EDGE))).filter("_run = _last and comes")
    newest = F.max(F.when(F.col("note").isNotNull(), F.struct("line_no", "note")))
    return last.groupBy(*EDGE).agg(newest["note"].alias("note"), F.min_by("via", "line_no").alias("via"), F.bool_and("unconfirmed").alias("unconfirmed"))


def statements_after(ops: DataFrame, statements: DataFrame) -> DataFrame:
    """Statements with good adds and, of each field, the last value that a good update gives."""
    good, said = ops.filter("problem is null"), lambda c: F.nullif(c, F.lit(""))
    new = good.filter("op = 'add'").select("full_id", "id", "namespace", "kind", said("modality").alias("modality"), "abstract", "body", F.coalesce(said("status"), F.lit("active")).alias("status"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce(said("provenance"), F.lit("dialogue")).alias("provenance_type"))
    if "created_at" in statements.columns:
        new = new.withColumn("created_at", F.current_timestamp())
    all_ = statements.unionByName(new.select(*[c for c in new.columns if c in statements.columns]), allowMissingColumns=True)
    last = lambda c: F.max(F.when(F.col(c) != "", F.struct("line_no", c)))[c].alias(f"_{c}")
    changes = good.filter("op = 'update'").groupBy("full_id").agg(last("body"), last("status"), last("modality"))
    modality = F.when(F.col("_modality") == "none", F.lit(None)).otherwise(F.coalesce("_modality", "modality"))
    return all_.join(changes, "full_id", "left").withColumns({"body": F.coalesce("_body", "body"), "status": F.coalesce("_status", "status"), "modality": modality}).select(*statements.columns)


def clearances_after(ops: DataFrame, statements: DataFrame, clearances: DataFrame) -> DataFrame:
    """Clearances, each under the hash of the body that the statement had at its line."""
    good = ops.filter("problem is null")
    bodies = statements.select("full_id", F.lit(0).cast("long").alias("line_no"), "body").unionByName(good.filter("op in ('add', 'update') and body <> ''").select("full_id", "line_no", "body"))
    marks = good.filter("op = 'dismiss' and open_wording").select(F.col("from_id").alias("full_id"), "line_no", "note")
    events = bodies.join(marks.select("full_id").distinct(), "full_id", "left_semi").withColumn("mark", F.lit(False)).unionByName(marks.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    upto = Window.partitionBy("full_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cleared = events.withColumn("_b", F.last("body", True).over(upto)).filter("mark")
    last = records.latest(cleared.select(F.col("full_id").alias("id"), F.sha2("_b", 256).alias("body_hash"), F.nullif("note", F.lit("")).alias("note"), "line_no"), ["id"], "line_no").drop("line_no")
    return records.upserted(clearances, last, ["id"])


def applied(lines: DataFrame, store: Store, duplicates: DataFrame | None = None) -> tuple[DataFrame, Store]:
    """(RESULTS by line, the tables) after the batch. A refused batch leaves the tables as they are, its results say why."""
    lines = stored(records.parsed(lines), "batch-read")  # each object is made once, not once a field
    checked = records.batch(lines)
    refused = records.batch_summary(checked).select((~F.col("applies")).alias("_no"))
    ops = stored(judged(lines, store, duplicates), "batch-lines")
    ops = ops.crossJoin(F.broadcast(refused)).withColumn("problem", F.when(F.col("_no"), F.coalesce("problem", F.lit("batch refused"))).otherwise(F.col("problem"))).drop("_no")  # one row
    ops = stored(ops, "batch")  # every table reads it
    events = stored(edge_events(ops, store.edges), "batch-edges")
    missing = _missing_edges(ops, events)
    ops = ops.join(missing, "line_no", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("_none"), "no such edge"))).drop("_none")
    out = ops.select("line_no", "op", F.coalesce(F.nullif("full_id", F.lit("")), "from_id").alias("full_id"), F.col("problem").isNull().alias("applied"), "problem")
    # lines that are no operations are results of a refused batch, too
    bad = checked.filter(F.col("problem").isNotNull()).select("line_no", "op", F.lit(None).cast("string").alias("full_id"), F.lit(False).alias("applied"), "problem")
    results = out.join(bad.select("line_no"), "line_no", "left_anti").unionByName(bad).orderBy("line_no")
    good = ops.filter("problem is null")
    said = lambda c: F.nullif(c, F.lit(""))
    refusals = good.filter("op = 'reject'").select("full_id", "namespace", "body", said("see_instead").alias("see_instead"))
    v = records.latest(good.filter("op = 'dismiss' and not open_wording").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b"), F.lit("not_related").alias("verdict"), said("note").alias("note"), "line_no"), ["a", "b"], "line_no").drop("line_no")
    return results, Store(
        statements_after(ops, store.statements), store.rejections.unionByName(refusals, allowMissingColumns=True), edges_after(events).select(*[c for c in store.edges.columns if c in (*EDGE, "note", "via", "unconfirmed")]),
        records.upserted(store.verdicts, v, ["a", "b"]), clearances_after(ops, store.statements, store.clearances),
    )


def _missing_edges(ops: DataFrame, events: DataFrame) -> DataFrame:
    """line_no, _none: unlinks that found no edge."""
    found = events.filter("not comes").groupBy("line_no").agg(F.bool_or("there").alias("_found"))
    cuts = ops.filter("problem is null and op = 'unlink'").select("line_no")
    return cuts.join(found, "line_no", "left").select("line_no", (~F.coalesce("_found", F.lit(False))).alias("_none"))

