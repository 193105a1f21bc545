"""check: what a draft would repeat or contradict, as one plan from retrieval to verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import text as T
from corvane.functions.porter import stem, stem_column
from corvane.operators import fusion, graph, lexical, listing, vectors
from corvane.operators.index import Index


@dataclass(frozen=True)
class Tables:
    """What a check reads. records: source_kind, full_id, namespace, body, status, tags and, for expansion, see_instead.

    index, if there is one, stands in for reading all bodies; it is the caller's to refresh before a read.
    """

    records: DataFrame
    facets: DataFrame
    edges: DataFrame
    embeddings: DataFrame | None = None
    index: Index | None = None


def live(records: DataFrame, namespace: str | None) -> DataFrame:
    """What search can rank: searchable statements and every rejection."""
    return records.filter((T.searchable(F.col("status")) | (F.col("source_kind") == "rejection")) & T.in_namespace(F.col("namespace"), namespace))


def wanted_facets(touches: list[str]):
    named = F.array(*[T.normalise_facet(F.lit(t)) for t in touches]) if touches else F.array().cast("array<string>")
    return F.filter(named, lambda f: f.isNotNull())


def touched(t: Tables, touches: list[str], namespace: str | None = None) -> DataFrame:
    """source_kind, full_id, hits of records that name one of the identifiers given; an exact key."""
    hits = t.facets.filter(F.array_contains(wanted_facets(touches), F.col("facet"))).groupBy("source_kind", "full_id").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(live(t.records, namespace).select("source_kind", "full_id"), ["source_kind", "full_id"], "left_semi")


def lexical_lists(t: Tables, draft: str, namespace: str | None, tags: list[str], limit: int, stemmed: bool) -> list[DataFrame]:
    phrases = lexical.draft_phrases(t.records.sparkSession, draft, stemmed)
    if not any(phrases):
        return []
    if t.index is not None and t.index.stemmed != stemmed:
        raise ValueError("the index and the draft must both be stemmed, or neither")
    order = [F.desc(F.round("score", 9)), "full_id"]
    cap = fusion.scan_cap(limit)
    if t.index is not None and cap:
        return _indexed_lists(t, phrases, namespace, tags, cap)
    if t.index is not None:
        scored = t.index.scores(phrases, t.index.counts(phrases))
    else:
        tok = lexical.tokenised(t.records)
        if stemmed:
            tok = lexical.stemmed_for(tok, phrases)
        scored = lexical.bm25(tok, phrases, lexical.corpus_counts(tok, phrases))
    rows = scored.join(live(t.records, namespace).select("source_kind", "full_id", "tags"), ["source_kind", "full_id"])
    s = rows.filter(F.col("source_kind") == "statement")
    for tag in tags:  # tags narrow this list only, and silence the rejections
        s = s.filter(F.array_contains("tags", tag))
    out = [fusion.ranked(s, "statements", "lexical", order, cap)]
    if not tags:
        out.append(fusion.ranked(rows.filter(F.col("source_kind") == "rejection"), "rejections", "lexical", order, cap))
    return out


def _indexed_lists(t: Tables, phrases: list[list[str]], namespace: str | None, tags: list[str], cap: int) -> list[DataFrame]:
    """The same lists from the index, which scores only shards that may hold one of the first `cap` records."""
    fit = live(t.records, namespace)
    if tags:
        fit = fit.filter(F.col("source_kind") == "statement")
        for tag in tags:
            fit = fit.filter(F.array_contains("tags", tag))
    best = t.index.top(phrases, t.index.counts(phrases), fit, cap)
    out = []
    for kind, name in (("statement", "statements"), ("rejection", "rejections"))[: 1 if tags else 2]:
        own = best.filter(F.col("source_kind") == kind)
        out.append(own.select(*fusion.KEY, F.lit(name).alias("list"), F.lit("lexical").alias("kind"), F.lit(None).cast("double").alias("similarity"), "pos"))
    return out


def hits(t: Tables, draft: str, namespace: str | None = None, tags: list[str] | None = None, touches: list[str] | None = None, vector: list[float] | None = None, model: str | None = None, limit: int = C.CHECK_LIMIT, stemmed: bool = True) -> DataFrame:
    """The fused page: source_kind, full_id, score, match_kind, similarity."""
    lists = lexical_lists(t, draft, namespace, tags or [], limit, stemmed)
    if vector:
        vectors.check_width(t.embeddings, vector, model)
        found = vectors.semantic(t.embeddings, vector, model).join(live(t.records, namespace).select("source_kind", "full_id"), ["source_kind", "full_id"], "left_semi")
        lists.append(fusion.ranked(found, "semantic", "semantic", [F.desc(F.round("similarity", 9)), "full_id", "source_kind"]))
    if touches:
        lists.append(fusion.ranked(touched(t, touches, namespace), "touches", "lexical", [F.desc("hits"), "full_id", "source_kind"]))
    if not lists:
        return t.records.select("source_kind", "full_id", F.lit(0.0).alias("score"), F.lit("lexical").alias("match_kind"), F.lit(None).cast("double").alias("similarity")).limit(0)
    all_ = lists[0]
    for x in lists[1:]:
        all_ = all_.unionByName(x)
    return fusion.fuse(all_, limit)


def draft_terms(spark, draft: str, stemmed: bool) -> list[str]:
    words = [w for p in lexical.draft_phrases(spark, draft, stemmed) for w in p]
    stop = {stem(w) for w in C.COVERAGE_STOPWORDS} if stemmed else set(C.COVERAGE_STOPWORDS)
    return sorted({w for w in words if len(w.encode()) >= C.MIN_STEM_BYTES and w not in stop})


def with_evidence(page: DataFrame, t: Tables, draft: str, touches: list[str] | None = None, stemmed: bool = True, bounded: bool = True) -> DataFrame:
    """A page with shared_facets, coverage, challenged, verdict, excerpt. Runs after the cut, so bodies are read for the page only; only a bounded page is broadcast."""
    spark = page.sparkSession
    terms = draft_terms(spark, draft, stemmed)
    asked = F.array_union(T.facets(F.lit(draft)), wanted_facets(touches or []))
    rows = (F.broadcast(page) if bounded else page).join(t.records.select("source_kind", "full_id", "body", "status"), ["source_kind", "full_id"], "left")
    words = T.tokens(F.coalesce("body", F.lit("")))
    if stemmed:
        bodies = rows.select("source_kind", "full_id", F.explode(F.array_distinct(words)).alias("w")).groupBy("source_kind", "full_id").agg(F.collect_set(stem_column("w")).alias("_words"))
        rows = rows.join(bodies, ["source_kind", "full_id"], "left").withColumn("_words", F.coalesce("_words", F.array().cast("array<string>")))
    else:
        rows = rows.withColumn("_words", words)
    wanted = F.array(*[F.lit(w) for w in terms]).cast("array<string>")
    covered = F.size(F.array_intersect(wanted, F.col("_words"))) / F.lit(float(max(1, len(terms))))
    marks = listing.challenged(t.records.filter(F.col("source_kind") == "statement"), t.edges).withColumn("_c", F.lit(True))
    rows = rows.withColumn("shared_facets", F.array_sort(F.array_intersect(asked, T.facets(F.coalesce("body", F.lit("")))))).withColumn("coverage", F.round(covered, 6)).join(marks, "full_id", "left")
    rows = rows.withColumn("challenged", F.coalesce("_c", F.lit(False)) & (F.col("source_kind") == "statement"))
    verdict = T.verdict(F.col("similarity"), F.size("shared_facets"), F.col("coverage"), F.lit(len(terms)))
    return rows.withColumn("verdict", verdict).withColumn("excerpt", T.excerpt(F.col("body"))).drop("_c", "_words", "body")


def settled(page: DataFrame, limit: int) -> DataFrame:
    """A page of at most `limit` rows as literals, so that the steps after the cut do not retrieve it again; unlimited ones stay lazy."""
    return page.sparkSession.createDataFrame(page.collect(), page.schema) if limit else page


def check(t: Tables, draft: str, namespace: str | None = None, tags: list[str] | None = None, touches: list[str] | None = None, vector: list[float] | None = None, model: str | None = None, limit: int = C.CHECK_LIMIT, stemmed: bool = True, expand: bool = True) -> DataFrame:
    """Direct hits in order with evidence, then graph neighbours (score 0); tags switch expansion off."""
    page = settled(hits(t, draft, namespace, tags, touches, vector, model, limit, stemmed), limit)
    page = page.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("score", 12)), "full_id", "source_kind")))
    cols = ["source_kind", "full_id", "score", "match_kind", "similarity", "pos"]
    all_ = page.select(*cols, F.lit(None).cast("string").alias("via_type"))
    if expand and not tags:
        near = graph.expand(page, t.edges, t.records, namespace, limit)
        near = settled(near, C.GRAPH_NEIGHBOURS)
        all_ = all_.unionByName(near.select("source_kind", "full_id", F.lit(0.0).alias("score"), F.lit("graph").alias("match_kind"), F.lit(None).cast("double").alias("similarity"), (F.col("pos") + 1_000_000).alias("pos"), "via_type"))
    out = with_evidence(all_, t, draft, touches, stemmed, bounded=limit > 0)
    return out.withColumn("score", F.round("score", 9)).withColumn("similarity", F.round("similarity", 6)).orderBy("pos")


def strongest(checked: DataFrame) -> DataFrame:
    """One row: the strongest verdict of a page, null for an empty one."""
    rank = F.when(F.col("verdict") == "duplicate", 2).when(F.col("verdict") == "related", 1).otherwise(0)
    return checked.agg(F.max(rank).alias("_v")).select(F.get(F.array(F.lit("weak"), F.lit("related"), F.lit("duplicate")), F.col("_v")).alias("verdict"))


def duplicates_of(t: Tables, draft: str, namespace: str | None = None, touches: list[str] | None = None) -> DataFrame:
    """The gate before adding: lexical and identifier hits only that read as duplicates."""
    return check(t, draft, namespace, touches=touches, limit=C.DUPLICATE_GATE_LIMIT, expand=False).filter(F.col("verdict") == "duplicate")


def related(corpora: dict[str, Tables], draft: str, limit: int = C.CHECK_LIMIT, **options) -> DataFrame:
    """The same check in other corpora, never fused with each other; ids carry the corpus's name. A caller's own vector is refused."""
    if options.get("vector"):
        raise ValueError("a vector belongs to one corpus; related corpora take none")
    out = None
    for name, t in corpora.items():
        page = check(t, draft, limit=limit, expand=False, **options).withColumn("project", F.lit(name)).withColumn("full_id", F.concat(F.lit(f"{name}:"), "full_id"))
        out = page if out is None else out.unionByName(page)
    return out
