"""Derivation and change of record tables: manifest diff, upserts, edge lists, mutations, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import text as T


# ---- incremental derivation --------------------------------------------------------------------------------


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, change (added, updated, removed, unchanged) between two manifests of (file_path, mtime_ns, size)."""
    o = old.select("file_path", F.col("mtime_ns").alias("_m"), F.col("size").alias("_s"))
    both = new.join(o, "file_path", "full_outer")
    change = F.when(F.col("_m").isNull(), "added").when(F.col("mtime_ns").isNull(), "removed").when((F.col("mtime_ns") != F.col("_m")) | (F.col("size") != F.col("_s")), "updated").otherwise("unchanged")
    return both.select("file_path", change.alias("change"))


def change_stats(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def applied(old: DataFrame, parsed: DataFrame, diff: DataFrame, key: str = "file_path") -> DataFrame:
    """old without rows of removed or updated files, with the rows parsed from added and updated ones."""
    gone = diff.filter(F.col("change").isin("removed", "updated")).select(F.col("file_path").alias(key))
    return old.join(gone, key, "left_anti").unionByName(parsed, allowMissingColumns=True)


def kept_vectors(embeddings: DataFrame, records: DataFrame) -> DataFrame:
    """An edit keeps its (now stale) vector, a removal drops it."""
    return embeddings.join(records.select("source_kind", "full_id"), ["source_kind", "full_id"], "left_semi")


def must_rederive(stored_version: str | None, current: str = C.DERIVATION_VERSION) -> bool:
    """Whether derived tables are older than this code; newer ones are left alone."""
    return stored_version is None or int(stored_version) < int(current)


# ---- keyed writes ------------------------------------------------------------------------------------------


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows put in place of those of equal keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_i = 1").drop("_i")


def merged_edges(edges: DataFrame) -> DataFrame:
    """One row per (from_id, to_id, type) of edges in pos order: the last note at the first place, confirmed if any entry is, the first non-empty via."""
    key = ["from_id", "to_id", "type"]
    via = F.when(F.coalesce("via", F.lit("")) != "", F.struct("pos", "via"))
    return edges.groupBy(*key).agg(F.min("pos").alias("pos"), F.max_by("note", "pos").alias("note"), F.bool_and("unconfirmed").alias("unconfirmed"), F.min(via)["via"].alias("via"))


# ---- mutations: tables in, tables out ----------------------------------------------------------------------


def problems(s: DataFrame) -> Column:
    """What keeps a statement from being written; empty when nothing does."""
    tests = [
        (T.valid_slug(F.col("id")), "id"),
        (T.valid_namespace(F.col("namespace")), "namespace"),
        (F.length(F.trim("body")) > 0, "body"),
        (F.col("status").isin(C.STATUSES), "status"),
        (F.col("modality").isNull() | F.col("modality").isin(C.MODALITIES), "modality"),
        (F.length(F.trim("kind")) > 0, "kind"),
    ]
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in tests]), lambda x: x.isNotNull())


def linked(edges: DataFrame, from_id: str, to_id: str, type_: str, note: str | None = None, confirmed: bool = True) -> DataFrame:
    """edges with one more; an existing one keeps its confirmation."""
    if type_ not in C.EDGE_TYPES:
        raise ValueError(f"unknown edge type {type_}")
    one = edges.sparkSession.createDataFrame([(from_id, to_id, type_, note, None, not confirmed)], "from_id string, to_id string, type string, note string, via string, unconfirmed boolean")
    all_ = edges.select(*one.columns).withColumn("pos", F.lit(0)).unionByName(one.withColumn("pos", F.lit(1)))
    return merged_edges(all_).select(*one.columns)


def unlinked(edges: DataFrame, from_id: str, to_id: str, type_: str | None = None) -> DataFrame:
    """edges without those from from_id to to_id, of one type if given."""
    hit = (F.col("from_id") == from_id) & (F.col("to_id") == to_id)
    return edges.filter(~(hit & (F.col("type") == type_) if type_ else hit))


def moved(statements: DataFrame, rejections: DataFrame, edges: DataFrame, embeddings: DataFrame, old: str, new: str, rewrite: bool = True, stub: bool = False):
    """The four tables after old becomes new: ids, edges, pointers, vectors and, with rewrite, ids in bodies. stub leaves a retired record and an edge at the old id."""
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    ns, _, slug = new.rpartition("/")
    is_old = F.col("full_id") == old
    body = T.rewrite_id(F.col("body"), F.lit(old), F.lit(new)) if rewrite else F.col("body")
    s = statements.withColumns({"id": F.when(is_old, slug).otherwise(F.col("id")), "namespace": F.when(is_old, ns).otherwise(F.col("namespace")), "body": body}).withColumn("full_id", swap("full_id"))
    e = edges.withColumns({"from_id": swap("from_id"), "to_id": swap("to_id")})
    if stub:
        left = statements.filter(is_old).withColumns({"status": F.lit("superseded"), "body": F.lit(f"Moved to {new}.")})
        s = s.unionByName(left)
        e = linked(e, old, new, "moved_to")
    r = rejections.withColumns({"see_instead": swap("see_instead"), "body": body})
    return s, r, e, embeddings.withColumn("full_id", swap("full_id"))


def dismissed(verdicts: DataFrame, a: str, b: str, note: str | None = None, restore: bool = False) -> DataFrame:
    """verdicts with the pair judged unrelated, or, with restore, without it."""
    a, b = min(a, b), max(a, b)
    rest = verdicts.filter(~((F.col("a") == a) & (F.col("b") == b)))
    if restore:
        return rest
    return rest.unionByName(verdicts.sparkSession.createDataFrame([(a, b, "not_related", note)], "a string, b string, verdict string, note string"), allowMissingColumns=True)


def with_vectors(embeddings: DataFrame, rows: DataFrame, force: bool = False) -> DataFrame:
    """embeddings with rows upserted. A model's width is fixed; force replaces that model's set (and no other) by rows of a new width."""
    widths = lambda d: {(r.model, r.dims) for r in d.select("model", "dims").distinct().collect()}  # noqa: E731  one row per model
    old, new = widths(embeddings), widths(rows)
    clash = {m for m, d in new for n, w in old if m == n and d != w}
    if len({m for m, _ in new}) != len(new) or (clash and not force):
        raise ValueError(f"vectors of another width for {sorted(clash) or sorted(new)}")
    rest = embeddings.filter(~F.col("model").isin(sorted(clash))) if clash else embeddings
    return upserted(rest, rows, ["source_kind", "full_id", "model"])


# ---- batches -----------------------------------------------------------------------------------------------

OPS = ["add", "update", "reject", "link", "unlink", "dismiss"]
NEEDS = {"add": ["namespace", "id", "kind", "body"], "update": ["full_id"], "reject": ["namespace", "id", "body"], "link": ["from", "to", "type"], "unlink": ["from", "to"], "dismiss": ["from"]}
TEXTS = ["op", "full_id", "namespace", "id", "kind", "body", "from", "to", "type", "note", "status", "modality", "see_instead", "provenance", "source"]
FLAGS = ["confirmed", "abstract", "duplicate_ok", "open_wording"]


FIELDS = "struct<" + ", ".join([*[f"`{n}`: string" for n in TEXTS], *[f"`{n}`: boolean" for n in FLAGS], "tags: array<string>"]) + ">"


def parsed(lines: DataFrame) -> DataFrame:
    """line_no, long, bad (no JSON object, or a field of another type than its own), o (FIELDS) of the lines that are not blank and no # comment; too long ones always."""
    trimmed = F.btrim("text", F.lit(" \t\n\x0b\f\r\u0085\u00a0"))
    rows = lines.select("line_no", trimmed.alias("text"), (F.octet_length("text") >= C.BATCH_LINE_BYTES).alias("long"))
    rows = rows.filter(F.col("long") | ((F.col("text") != "") & ~F.col("text").startswith("#"))).withColumn("v", F.try_parse_json("text"))
    right = {n: "STRING" for n in TEXTS} | {n: "BOOLEAN" for n in FLAGS} | {"tags": "ARRAY<STRING> ARRAY<VOID>"}
    kinds = F.array(*[F.struct(F.schema_of_variant(F.try_variant_get("v", f"$.{n}", "variant")).alias("k"), F.split(F.lit(f"VOID {r}"), " ").alias("r")) for n, r in right.items()])
    off = F.exists(kinds, lambda x: F.coalesce(~F.array_contains(x["r"], x["k"]), F.lit(False)))
    whole = F.schema_of_variant("v")
    bad = F.col("v").isNull() | ~(whole.startswith("OBJECT<") | (whole == "VOID")) | off
    return rows.select("line_no", "long", bad.alias("bad"), F.try_variant_get("v", "$", FIELDS).alias("o"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"o.`{name}`"), F.lit(""))


def batch(lines: DataFrame) -> DataFrame:
    """line_no, op, problem of operations given one JSON object a line (line_no, text), or of what parsed() says of such; null problem means it is one.

    Blank and # lines are skipped. An update must say what it changes; a dismissal names a pair, or with open_wording one statement.
    """
    return _checked(lines).select("line_no", F.when(~F.col("long") & ~F.col("bad"), F.nullif(_text("op"), F.lit(""))).alias("op"), "problem")


def _checked(lines: DataFrame) -> DataFrame:
    rows, op = lines if "o" in lines.columns else parsed(lines), _text("op")
    needs = F.create_map(*[F.lit(x) for name, needed in NEEDS.items() for x in (name, ",".join(needed))])
    held = F.create_map(*[x for n in sorted({n for needed in NEEDS.values() for n in needed}) for x in (F.lit(n), _text(n))])
    lack = F.array_join(F.filter(F.split(F.coalesce(F.try_element_at(needs, op), F.lit("")), ","), lambda n: F.try_element_at(held, n) == ""), ",")
    missing = F.when(lack != "", F.concat(F.lit("missing "), lack))
    idle = F.when((op == "update") & (F.concat(_text("body"), _text("status"), _text("modality")) == ""), "nothing to update")
    wording = F.coalesce("o.open_wording", F.lit(False))
    pair = F.when((op == "dismiss") & wording & (_text("to") != ""), "open_wording clears one statement").when((op == "dismiss") & ~wording & (_text("to") == ""), "missing to")
    problem = F.when(F.col("long"), "too long").when(F.col("bad"), "malformed").when(op == "", "missing op").when(~op.isin(OPS), "unknown op").otherwise(F.coalesce(missing, idle, pair))
    return rows.withColumn("problem", problem)


def operations(lines: DataFrame) -> DataFrame:
    """line_no, op, problem (null) and every field of the lines that are operations; missing texts are empty, missing flags false.

    Every field is read from the line's object: hand in parsed() lines that are kept somewhere, or the objects are made once a field.
    """
    rows = _checked(lines).filter("problem is null")
    own = F.when(_text("op").isin("add", "reject"), F.concat_ws("/", _text("namespace"), _text("id"))).otherwise(_text("full_id"))
    names = {"from": "from_id", "to": "to_id"}
    texts = [_text(n).alias(names.get(n, n)) for n in TEXTS if n != "full_id"]
    return rows.select("line_no", F.lit(None).cast("string").alias("problem"), own.alias("full_id"), *texts, *[F.coalesce(f"o.{n}", F.lit(False)).alias(n) for n in FLAGS], "o.tags")


def batch_summary(checked: DataFrame) -> DataFrame:
    """total, failed, applies: one line that is no operation, or none that is one, keeps the whole batch from being applied."""
    failed = F.count_if(F.col("problem").isNotNull())
    return checked.agg(F.count(F.lit(1)).alias("total"), failed.alias("failed"), ((failed == 0) & (F.count(F.lit(1)) > 0)).alias("applies"))
