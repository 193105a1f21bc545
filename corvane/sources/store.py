"""The Markdown record store: statements, rejections, verdicts and clearances as DataFrames, and their writing.

Files are read whole by Spark (any file system it knows), split by built-in
functions, and only the front matter's YAML goes through Python (front.py), in Arrow batches.
Reading tolerates what writing refuses: an unknown modality reads as unset and
duplicate edges collapse; a file whose front matter cannot be read is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.operators.records import merged_edges
from corvane.sources import front, ignore, sink

ENTRY_SEPARATOR = r"(?m)^<!--[^>]*-->\s*$"
FRONT = r"(?s)\A---[ \t]*\n(.*?)(?:^|\n)---[ \t]*(?:\n(.*))?\z"


def files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """file_path (below root), mtime, size, content of every file."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    base = root.rstrip("/").rpartition("/")[2]
    path = F.regexp_extract(F.col("_metadata.file_path"), rf"/{re.escape(base)}/(.*)$", 1)
    return raw.select(path.alias("file_path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("content"))


def _hidden(spark: SparkSession, root: str, name: str) -> DataFrame:
    """file_path, content of files of a name that Spark's readers skip because it begins with an underscore: an older layout, one such file a namespace at most."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(sc._jsc.hadoopConfiguration())
    base, rows, found = fs.makeQualified(top).toString().rstrip("/") + "/", [], fs.listFiles(top, True)
    while found.hasNext():
        path = found.next().getPath()
        if path.getName() == name:
            stream = fs.open(path)
            try:
                rows.append((path.toString().removeprefix(base), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return spark.createDataFrame(rows, "file_path string, content string")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """file_path, mtime_ns, size, without reading contents."""
    f = files(spark, root)
    return f.select("file_path", (F.unix_micros("mtime") * 1000).alias("mtime_ns"), "size")


def front_matter(content: Column) -> Column:
    """front and body of a record file: the first two fences only, the first at the very start."""
    norm = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    return F.when(norm.rlike(FRONT), F.struct(F.regexp_extract(norm, FRONT, 1).alias("front"), F.btrim(F.regexp_extract(norm, FRONT, 2), F.lit("\n")).alias("body")))


FRONT_JSON = (
    "kind string, modality string, abstract boolean, status string, tags array<string>, provenance struct<type string, file string, line_range struct<start int, `end` int>, hash string>, created_at timestamp, "
    "relationships array<struct<to string, type string, note string, via string, unconfirmed boolean>>, id string, see_instead string, rejected_at timestamp, a string, b string, verdict string, decided_at timestamp, body_hash string, cleared_at timestamp"
)


def _parsed(df: DataFrame) -> DataFrame:
    """df with front parsed by FRONT_JSON (column m). A front matter that is none, or that cannot be read, is an error that names the file."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(path, text):
            if text is None:
                raise front.FrontError(f"{path}: no front matter between two lines of ---")
            try:
                return json.dumps(front.parse(text))
            except front.FrontError as e:
                raise front.FrontError(f"{path}: {e}") from e

        for pdf in batches:
            yield pdf.assign(front=[one(p, t) for p, t in zip(pdf["file_path"], pdf["front"])])

    return df.mapInPandas(run, df.schema).withColumn("m", F.from_json("front", FRONT_JSON)).select(*names, "m")


def statements(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(statements, edges) below root; namespace and id come from the path, never from the file."""
    f = files(spark, root).filter(~F.col("file_path").endswith(".rejected.md") & ~F.col("file_path").endswith("_rejected.md"))
    f = f.withColumn("r", front_matter(F.col("content"))).select("file_path", F.col("r.front").alias("front"), F.col("r.body").alias("body"))
    p = _parsed(f)
    full_id = F.regexp_replace("file_path", r"\.md$", "")
    named = p.withColumns({"full_id": full_id, "id": F.regexp_extract(full_id, r"([^/]+)$", 1), "namespace": F.regexp_extract(full_id, r"^(.*)/[^/]+$", 1)})
    known = F.when(F.col("m.modality").isin(C.MODALITIES), F.col("m.modality"))
    s = named.select(
        "full_id", "id", "namespace", F.col("m.kind").alias("kind"), known.alias("modality"), F.coalesce("m.abstract", F.lit(False)).alias("abstract"), "body", F.col("m.status").alias("status"),
        F.coalesce("m.tags", F.array().cast("array<string>")).alias("tags"), F.col("m.provenance.type").alias("provenance_type"), F.col("m.provenance.file").alias("source_file"),
        F.col("m.provenance.line_range.start").alias("line_start"), F.col("m.provenance.line_range.end").alias("line_end"), F.col("m.provenance.hash").alias("source_hash"), F.col("m.created_at").alias("created_at"), "file_path",
    )
    e = named.select(F.col("full_id").alias("from_id"), F.posexplode("m.relationships").alias("pos", "r")).select("from_id", F.col("r.to").alias("to_id"), F.col("r.type").alias("type"), F.col("r.note").alias("note"), F.col("r.via").alias("via"), F.coalesce("r.unconfirmed", F.lit(False)).alias("unconfirmed"), "pos")
    return s, merged_edges(e).drop("pos")


def rejections(spark: SparkSession, root: str) -> DataFrame:
    """One file per rejection (<id>.rejected.md), or the older file of many (_rejected.md)."""
    f = files(spark, root, "*.rejected.md").select("file_path", "content").unionByName(_hidden(spark, root, "_rejected.md"))
    path = F.col("file_path")
    own = F.regexp_extract(path, r"([^/]+)\.rejected\.md$", 1)
    f = f.select("file_path", own.alias("own"), F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("namespace"), F.explode(F.when(own != "", F.array("content")).otherwise(F.split("content", ENTRY_SEPARATOR))).alias("entry"))
    f = f.filter(F.btrim("entry", F.lit(" \n\t\r")) != "").withColumn("r", front_matter(F.btrim("entry", F.lit(" \n\t\r")))).select("file_path", "own", "namespace", F.col("r.front").alias("front"), F.col("r.body").alias("body"))
    p = _parsed(f)
    return p.select(F.concat_ws("/", "namespace", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("m.id"))).alias("full_id"), "namespace", "body", F.col("m.see_instead").alias("see_instead"), F.col("m.rejected_at").alias("rejected_at"), "file_path")


def verdicts(spark: SparkSession, root: str) -> DataFrame:
    p = _flat(spark, root)
    return p.select(F.least("m.a", "m.b").alias("a"), F.greatest("m.a", "m.b").alias("b"), F.col("m.verdict").alias("verdict"), F.col("body").alias("note"), F.col("m.decided_at").alias("decided_at"), "file_path")


def clearances(spark: SparkSession, root: str) -> DataFrame:
    p = _flat(spark, root)
    return p.select(F.col("m.id").alias("id"), F.col("m.body_hash").alias("body_hash"), F.col("m.cleared_at").alias("cleared_at"), F.col("body").alias("note"))


def _flat(spark: SparkSession, root: str) -> DataFrame:
    f = files(spark, root).withColumn("r", front_matter(F.col("content"))).select("file_path", F.col("r.front").alias("front"), F.col("r.body").alias("body"))
    return _parsed(f)


#: Documents at the top that a tool writes, with example labels in them (fixed values).
GENERATED = ("AGENTS.md", "CLAUDE.md", "CLAUDE.local.md")


def source_lines(spark: SparkSession, root: str, skip: tuple[str, ...] = GENERATED, rules: list[ignore.Rule] | None = None) -> DataFrame:
    """file, line, text of text files below root. Left out: files or folders named in skip (the store, generated documents), what the tree's ignore rules drop, and files with a zero byte."""
    f = files(spark, root, "*")
    for s in skip:
        f = f.filter((F.col("file_path") != s) & ~F.col("file_path").startswith(s + "/"))
    f = f.filter(~ignore.ignored(F.col("file_path"), ignore.rules_of(spark, root) if rules is None else rules))
    f = f.filter(~F.contains("content", F.lit("\u0000")))
    return f.select(F.col("file_path").alias("file"), F.posexplode(F.split("content", "\n")).alias("_p", "text")).select("file", (F.col("_p") + 1).alias("line"), "text")


def patch_lines(spark: SparkSession, path: str) -> DataFrame:
    """patch, pos, line of unified diff files, one patch a file; what diffcheck.parse_patch reads."""
    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("patch"), "value")
    return f.select("patch", F.posexplode(F.split("value", "\n")).alias("pos", "line"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, text of a batch file, for records.batch. One file is one batch, so lines keep their order in it."""
    f = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("_p", "text"))
    return f.select((F.col("_p") + 1).cast("long").alias("line_no"), F.regexp_replace("text", "\r$", "").alias("text"))


# ---- sinks -------------------------------------------------------------------------------------------------


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A derived table, replaced as a whole; committed by Spark's output committer, so readers see the old or the new one."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def record_text(s: DataFrame) -> DataFrame:
    """file_path, content: statements as the Markdown that statements() reads."""
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\n"))).otherwise("")

    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("  - "), quoted(t), F.lit("\n"))), ""))).otherwise("")
    where = F.concat(F.lit("provenance:\n"), line("  type", F.col("provenance_type")), line("  file", F.col("source_file")), F.when(F.col("line_start").isNotNull(), F.concat(F.lit("  line_range:\n    start: "), F.col("line_start").cast("string"), F.lit("\n    end: "), F.col("line_end").cast("string"), F.lit("\n"))).otherwise(""), line("  hash", F.col("source_hash")))
    made = line("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    front = F.concat(line("id", F.col("id")), line("namespace", F.col("namespace")), line("kind", F.col("kind")), line("modality", F.col("modality")), F.when(F.col("abstract"), "abstract: true\n").otherwise(""), line("status", F.col("status")), tags, where, made)
    return s.select("file_path", F.concat(F.lit("---\n"), front, F.lit("---\n\n"), F.btrim("body", F.lit("\n ")), F.lit("\n")).alias("content"))


def write_records(texts: DataFrame, root: str) -> None:
    """Each (file_path, content) as one file below root, all or none (sink.py); a null content removes the file."""
    sink.write(texts, root)
