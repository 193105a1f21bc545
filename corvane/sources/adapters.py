"""Record tables derived from the driver's tables by fixed formulas, in Spark and in SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import text as T
from corvane.session import table

MODEL = "m64"
LINKABLE = C.EDGE_TYPES[:6]
SENT_ROWS = 1_000_000  # parts that may be sent to all: Spark judges by a file's bytes, of which a million keys are few, and the driver holds every one


def _pick(names: list[str | None], number: Column, *, modulus: int) -> Column:
    return F.get(F.array(*[F.lit(x).cast("string") for x in names]), (number % modulus).cast("int"))


@dataclass(frozen=True)
class Corpus:
    """Lazy record tables over one data directory."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def n(self) -> int:
        return self.table("documents").count()  # from the files' footers

    @cached_property
    def many_parts(self) -> bool:
        return self.table("part").count() > SENT_ROWS  # from the files' footers

    @cached_property
    def statements(self) -> DataFrame:
        part = self.table("part").select("p_partkey", F.concat(F.lit(" "), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), F.col("p_size").cast("string")).alias("name"))
        d = self.table("documents").join(part.hint("merge") if self.many_parts else part, F.col("doc_id") == F.col("p_partkey"))
        i, line = F.col("doc_id"), (F.col("doc_id") % 40 + 1).cast("int")
        return d.select(
            F.concat(F.lit("doc/"), "lang", F.lit("/"), i.cast("string")).alias("full_id"), i.cast("string").alias("id"), F.concat(F.lit("doc/"), "lang").alias("namespace"),
            _pick(["rule", "choice", "principle"], i, modulus=3).alias("kind"), _pick([*C.MODALITIES, None], i, modulus=6).alias("modality"), (i % 17 == 0).alias("abstract"),
            F.concat("text", "name").alias("body"), _pick(["active"] * 6 + ["proposed"] * 2 + ["superseded", "deprecated"], i, modulus=10).alias("status"),
            F.array("source", "lang").alias("tags"), _pick(["dialogue", "code-derived"], i, modulus=2).alias("provenance_type"), F.col("source").alias("source_file"),
            line.alias("line_start"), (line + 5).alias("line_end"), F.lit(None).cast("string").alias("source_hash"),
            F.timestamp_seconds(F.lit(1_700_000_000) + i * 60).alias("created_at"), F.concat(F.lit("statements/"), "lang", F.lit("/"), i.cast("string"), F.lit(".md")).alias("file_path"), i.alias("doc_id"),
        )

    @cached_property
    def ids(self) -> DataFrame:
        """doc_id, full_id without bodies."""
        return self.table("documents").select("doc_id", F.concat(F.lit("doc/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("full_id"))

    @cached_property
    def rejections(self) -> DataFrame:
        b = self.table("benchmark").withColumn("_to", F.when(F.col("item_id") % 9 != 0, F.col("item_id") * 3 % self.n))
        to = self.ids.select(F.col("doc_id").alias("_to"), F.col("full_id").alias("see_instead"))
        return b.join(to, "_to", "left").select(
            F.concat(F.lit("rej/"), F.col("item_id").cast("string")).alias("full_id"), F.lit("rej").alias("namespace"), F.col("text").alias("body"),
            F.when(F.col("item_id") % 9 == 0, "doc/nowhere").otherwise(F.col("see_instead")).alias("see_instead"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("item_id") * 60).alias("rejected_at"), F.concat(F.lit("statements/rej/"), F.col("item_id").cast("string"), F.lit(".rejected.md")).alias("file_path"),
        )

    @cached_property
    def records(self) -> DataFrame:
        """source_kind, full_id, namespace, body, status, tags of statements and rejections."""
        s = self.statements.select(F.lit("statement").alias("source_kind"), "full_id", "namespace", "body", "status", "tags")
        r = self.rejections.select(F.lit("rejection").alias("source_kind"), "full_id", "namespace", "body", F.lit(None).cast("string").alias("status"), F.array().cast("array<string>").alias("tags"))
        return s.unionByName(r)

    @cached_property
    def edges(self) -> DataFrame:
        a, b = self.ids, self.ids.select(F.col("doc_id").alias("_to"), F.col("full_id").alias("to_id"))
        e = a.withColumn("_to", (F.col("doc_id") * 7 + 3) % self.n).filter("doc_id <> _to").join(b, "_to")
        return e.select(F.col("full_id").alias("from_id"), "to_id", _pick(LINKABLE, F.col("doc_id"), modulus=6).alias("type"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("via"), (F.col("doc_id") % 4 == 0).alias("unconfirmed"))

    @cached_property
    def verdicts(self) -> DataFrame:
        a, b = self.ids.filter("doc_id % 5 = 0"), self.ids.select((F.col("doc_id") - 1).alias("doc_id"), F.col("full_id").alias("_b"))
        return a.join(b, "doc_id").select(F.least("full_id", "_b").alias("a"), F.greatest("full_id", "_b").alias("b"), F.lit("not_related").alias("verdict"))

    @cached_property
    def embeddings(self) -> DataFrame:
        e = self.table("embeddings").join(self.statements.select(F.col("doc_id").alias("vec_id"), "full_id", "body"), "vec_id")
        return e.select(F.lit("statement").alias("source_kind"), "full_id", F.lit(MODEL).alias("model"), F.size("embedding").alias("dims"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 11 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("body", 256)).alias("source_hash"))

    @cached_property
    def facets(self) -> DataFrame:
        return self.records.select("source_kind", "full_id", F.explode(T.facets(F.col("body"))).alias("facet"))

    @cached_property
    def sites(self) -> DataFrame:
        """file, line, text of source lines that carry labels, some mistyped, unknown or ignored."""
        e = self.table("events").select("event_id", "event_type", (F.col("event_id") * 3 % self.n).alias("doc_id")).join(self.ids, "doc_id")
        i = F.col("event_id")
        name = F.when(i % 17 == 0, F.concat(F.lit("nowhere/at-all-"), i.cast("string"))).when(i % 13 == 0, F.concat(F.substring("full_id", 1, 3), F.lit("x"), F.expr("substring(full_id, 4)"))).otherwise(F.col("full_id"))
        mark = F.when(i % 19 == 0, "// decision:ignore decision: ").when(i % 2 == 0, "// Decision : ").otherwise("# decision:")
        ext = F.when(i % 5 == 0, ".md").otherwise(".go")
        return e.select(F.concat(F.lit("src/"), "event_type", ext).alias("file"), i.cast("int").alias("line"), F.concat(mark, name, F.lit(" more words")).alias("text"))

    @cached_property
    def hunks(self) -> DataFrame:
        l = self.table("lineitem")
        start = (F.col("l_linenumber") * 5).cast("int")
        return l.select(F.concat(F.lit("src"), (F.col("l_suppkey") % 20).cast("string")).alias("file"), start.alias("start"), (start + F.col("l_quantity").cast("int") % 7).alias("end")).distinct()


BASE = """
WITH n AS (SELECT count(*) AS n FROM documents),
ids AS (SELECT doc_id, 'doc/' || lang || '/' || doc_id AS full_id FROM documents),
statements AS (
  SELECT 'doc/' || lang || '/' || doc_id AS full_id, doc_id::VARCHAR AS id, 'doc/' || lang AS namespace, ['rule', 'choice', 'principle'][doc_id % 3 + 1] AS kind,
         ['must', 'should', 'may', 'must_not', 'should_not', NULL][doc_id % 6 + 1] AS modality, doc_id % 17 = 0 AS abstract,
         text || ' ' || lower(replace(p_name, ' ', '_')) || '_' || p_size AS body,
         ['active', 'active', 'active', 'active', 'active', 'active', 'proposed', 'proposed', 'superseded', 'deprecated'][doc_id % 10 + 1] AS status,
         [source, lang] AS tags, source AS source_file, (doc_id % 40 + 1)::INT AS line_start, (doc_id % 40 + 6)::INT AS line_end, doc_id
  FROM documents JOIN part ON p_partkey = doc_id),
rejections AS (
  SELECT 'rej/' || item_id AS full_id, 'rej' AS namespace, text AS body, CASE WHEN item_id % 9 = 0 THEN 'doc/nowhere' ELSE ids.full_id END AS see_instead
  FROM benchmark CROSS JOIN n LEFT JOIN ids ON doc_id = item_id * 3 % n.n AND item_id % 9 <> 0),
records AS (
  SELECT 'statement' AS source_kind, full_id, namespace, body, status, tags FROM statements
  UNION ALL SELECT 'rejection', full_id, namespace, body, NULL, [] FROM rejections),
edges AS (
  SELECT a.full_id AS from_id, b.full_id AS to_id, ['conflicts_with', 'supersedes', 'depends_on', 'refines', 'duplicates', 'moved_to'][a.doc_id % 6 + 1] AS type, a.doc_id % 4 = 0 AS unconfirmed
  FROM ids a CROSS JOIN n JOIN ids b ON b.doc_id = (a.doc_id * 7 + 3) % n.n WHERE a.doc_id <> b.doc_id),
verdicts AS (SELECT least(a.full_id, b.full_id) AS a, greatest(a.full_id, b.full_id) AS b FROM ids a JOIN ids b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 5 = 0),
embeddings_ AS (
  SELECT 'statement' AS source_kind, full_id, 'm64' AS model, embedding AS vector, CASE WHEN vec_id % 11 = 0 THEN sha256('old') ELSE sha256(body) END AS source_hash
  FROM embeddings JOIN statements ON vec_id = doc_id),
raw_facets AS (
  SELECT source_kind, full_id, unnest(regexp_extract_all(body, '\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b') || regexp_extract_all(body, ':[a-z][a-z0-9_]*(?:_[a-z0-9]+)*\\b')
    || regexp_extract_all(body, '\\b[a-z][a-z0-9_]*(?:\\.[a-z][a-z0-9_]*)+\\b') || regexp_extract_all(body, '\\b[a-z]+[A-Z][A-Za-z0-9]*\\b') || regexp_extract_all(body, '\\b[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*\\b')) AS raw
  FROM records),
trimmed AS (SELECT DISTINCT source_kind, full_id, trim(CASE WHEN lower(raw) LIKE ':%' THEN substr(lower(raw), 2) ELSE lower(raw) END, '.,;:()[]`''"') AS facet FROM raw_facets),
facets AS (
  SELECT source_kind, full_id, facet FROM trimmed
  WHERE strlen(facet) >= 3 AND NOT regexp_full_match(facet, '[0-9._-]*') AND list_max(list_transform(string_split_regex(facet, '[._-]'), lambda x: strlen(x))) >= 2
    AND facet NOT IN ('e.g', 'i.e', 'etc.etc', {vocabulary})
  QUALIFY row_number() OVER (PARTITION BY source_kind, full_id ORDER BY facet) <= 32),
sites AS (
  SELECT 'src/' || event_type || CASE WHEN event_id % 5 = 0 THEN '.md' ELSE '.go' END AS file, event_id::INT AS line,
         CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'nowhere/at-all-' || event_id
              WHEN event_id % 13 = 0 THEN substr(full_id, 1, 3) || 'x' || substr(full_id, 4) ELSE full_id END AS full_id
  FROM events CROSS JOIN n JOIN ids ON doc_id = event_id * 3 % n.n),
refs AS (SELECT file, line, full_id, CASE WHEN file LIKE '%.md' THEN 'doc' ELSE 'code' END AS kind FROM sites WHERE full_id IS NOT NULL),
hunks AS (SELECT DISTINCT 'src' || l_suppkey % 20 AS file, (l_linenumber * 5)::INT AS start, (l_linenumber * 5 + l_quantity::INT % 7)::INT AS "end" FROM lineitem)
""".replace("\\\\", "\\").replace("{vocabulary}", ", ".join(f"'{x}'" for x in C.OWN_VOCABULARY))
