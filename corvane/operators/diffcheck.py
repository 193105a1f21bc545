"""Checks scoped to a patch: hunks and changed text against labels, source ranges and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import text as T
from corvane.operators import trace


HUNK = r"^@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
BIN = 256  # lines; a range stands in every bin it meets


def parse_patch(patch_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hunks: patch, file, start, end; changes: patch, file, added, removed) of patch_lines (patch, pos, line).

    A hunk's header says how many lines of the old and the new file follow, so a changed line is told from a file's
    header by what the hunk still lacks, whatever it looks like: running counts per hunk. A missing length is one; a hunk
    without new lines stands at its boundary. A file that is deleted goes by its old name.
    """
    length = lambda i: F.coalesce(F.regexp_extract("line", HUNK, i).try_cast("int"), F.lit(1))
    order = Window.partitionBy("patch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = patch_lines.withColumn("_head", F.col("line").rlike(HUNK)).withColumn("_k", F.count_if("_head").over(order))
    hunk = Window.partitionBy("patch", "_k").orderBy("pos")
    before = hunk.rowsBetween(Window.unboundedPreceding, -1)
    first = F.substring("line", 1, 1)
    both = (first == " ") | (F.col("line") == "")  # some tools cut the space of an empty line
    old, new = F.count_if(~F.col("_head") & (both | (first == "-"))), F.count_if(~F.col("_head") & (both | (first == "+")))
    lacks = lambda i, seen: F.first(F.when(F.col("_head"), length(i)), True).over(hunk) > F.coalesce(seen.over(before), F.lit(0))
    over = F.coalesce(F.max(F.col("line").startswith("diff --git ")).over(hunk), F.lit(False))
    rows = rows.withColumn("_in", F.coalesce((F.col("_k") > 0) & ~F.col("_head") & ~over & (lacks(1, old) | lacks(3, new)), F.lit(False)))
    name = lambda sign, side: F.when(~F.col("_in") & F.col("line").startswith(sign), F.regexp_extract("line", rf"^.{{4}}(?:{side}/)?(.+?)\s*$", 1))
    rows = rows.withColumn("_new", F.when(F.col("line").startswith("diff --git "), F.lit("")).otherwise(name("+++ ", "b"))).withColumn("_old", name("--- ", "a"))
    rows = rows.withColumn("_file", F.last("_new", True).over(order)).withColumn("_from", F.last("_old", True).over(order))
    rows = rows.withColumn("file", F.when(F.col("_file") == "/dev/null", F.col("_from")).otherwise(F.nullif("_file", F.lit(""))))
    start, size = F.regexp_extract("line", HUNK, 2).try_cast("int"), length(3)
    hunks = rows.filter("_head and file is not null").select("patch", "file", start.alias("start"), (start + F.greatest(size, F.lit(1)) - 1).alias("end"))
    text = lambda sign: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").startswith(sign), F.struct("pos", F.expr("substring(line, 2)").alias("t"))))), lambda x: x["t"]), "\n")
    return hunks, rows.filter("_in and file is not null").groupBy("patch", "file").agg(text("+").alias("added"), text("-").alias("removed"))


def _bins(start, end):
    """The bins that lines start to end meet."""
    return F.explode(F.sequence(F.floor(start / BIN), F.floor(end / BIN)))


def outside(df: DataFrame, store: str) -> DataFrame:
    """Rows whose file is not the store itself nor below it."""
    return df.filter((F.col("file") != store) & ~F.col("file").startswith(store + "/"))


def label_cover(classes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Labels on a changed line: reason label, or contradiction for code labels of decisions not in force. Dangling ones cover nothing."""
    h = hunks.select("file", "start", "end").distinct().withColumn("_bin", _bins(F.col("start"), F.col("end")))
    at = classes.filter(F.col("class") != "dangling").withColumn("_bin", F.floor(F.col("line") / BIN))
    hit = at.join(h, ["file", "_bin"]).filter("line between start and end").select("full_id", "file", "line", "kind", "class").distinct()
    bad = F.col("class").isin("retired", "rejected", "abstract") & (F.col("kind") == "code")
    return hit.select(F.when(bad, "contradiction").otherwise("label").alias("reason"), "full_id", "file", "line", F.lit(None).cast("string").alias("facet"))


def provenance_cover(statements: DataFrame, hunks: DataFrame) -> DataFrame:
    """Statements whose source range meets a hunk, whatever their status. Ranges are joined by file and bin, so a file of very many hunks is no one task's."""
    s = statements.filter("source_file is not null and line_start <= line_end").select("full_id", F.col("source_file").alias("file"), "line_start", "line_end")
    s = s.withColumn("_bin", _bins(F.col("line_start"), F.col("line_end")))
    h = hunks.select("file", "start", "end").distinct().withColumn("_bin", _bins(F.col("start"), F.col("end")))
    hit = s.join(h, (s["file"] == h["file"]) & (s["_bin"] == h["_bin"]) & (h["start"] <= s["line_end"]) & (s["line_start"] <= h["end"]), "left_semi")
    return hit.select("full_id", "file", "line_start").distinct().select(F.lit("provenance").alias("reason"), "full_id", "file", F.col("line_start").alias("line"), F.lit(None).cast("string").alias("facet"))


def identifier_cover(changes: DataFrame, facets: DataFrame) -> DataFrame:
    """Records that name an identifier of the added text; statements and rejections apart, whatever their status."""
    added = changes.select("file", F.explode(T.facets(F.col("added"))).alias("facet")).distinct()
    hit = added.join(facets, "facet")
    return hit.select(F.when(F.col("source_kind") == "rejection", "rejection").otherwise("identifier").alias("reason"), "full_id", "file", F.lit(None).cast("int").alias("line"), "facet").distinct()


def dropped(removed_refs: DataFrame, refs: DataFrame, statements: DataFrame) -> DataFrame:
    """full_id, files: searchable, not abstract statements whose last label the patch removed."""
    gone = removed_refs.join(refs.filter(F.col("kind") == "code").select("full_id").distinct(), "full_id", "left_anti")
    live = statements.filter(T.searchable(F.col("status")) & ~F.col("abstract")).select("full_id")
    return gone.join(live, "full_id", "left_semi").groupBy("full_id").agg(F.array_sort(F.collect_set("file")).alias("files"))


def covered(parts: list[DataFrame]) -> DataFrame:
    """The union of covering reasons, one row per reason, id, file and identifier, in report order."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    one = all_.groupBy("reason", "full_id", "file", "facet").agg(F.min("line").alias("line"))
    place = F.when(F.col("reason") == "label", 0).when(F.col("reason") == "provenance", 1).when(F.col("reason") == "identifier", 2).otherwise(3)
    return one.orderBy(place, "full_id", "line", "file", "facet")


def removed_labels(changes: DataFrame, marker: str = C.MARKER) -> DataFrame:
    """full_id, file of labels in removed code lines."""
    lines = changes.select("file", F.posexplode(F.split("removed", "\n")).alias("line", "text"))
    return trace.scan(lines, marker).filter(F.col("kind") == "code").select("full_id", "file").distinct()


def gate(cover: DataFrame, gone: DataFrame, stale: DataFrame) -> DataFrame:
    """One row, failed: a contradiction, a dropped label or a stale covering statement."""
    bad = cover.filter(F.col("reason") == "contradiction").select("full_id").unionByName(gone.select("full_id")).unionByName(cover.join(stale, "full_id", "left_semi").select("full_id"))
    return bad.agg((F.count(F.lit(1)) > 0).alias("failed"))
