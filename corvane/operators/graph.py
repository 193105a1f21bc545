"""One-hop expansion from the best hits along typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import text as T


def expand(hits: DataFrame, edges: DataFrame, records: DataFrame, namespace: str | None = None, limit: int = C.CHECK_LIMIT) -> DataFrame:
    """source_kind, full_id, via_from, via_to, via_type, unconfirmed, pos of neighbours of the first GRAPH_SEEDS hits.

    hits has source_kind, full_id and pos (from 1); a page of `limit` rows is sent to all, an unlimited one (0) is joined as it is.
    An edge type without a priority ranks like conflicts_with (0), as observed.
    """
    seeds = F.broadcast(hits.filter(F.col("pos") <= C.GRAPH_SEEDS).select(F.col("source_kind").alias("_sk"), F.col("full_id").alias("_seed"), (F.col("pos") - 1).alias("_n")))
    s, r = F.col("_sk") == "statement", F.col("_sk") == "rejection"
    rejections = records.filter((F.col("source_kind") == "rejection") & F.col("see_instead").isNotNull() & (F.col("see_instead") != "")).select("full_id", "see_instead")
    no = F.lit(False)
    cols = lambda kind, key, a, b, t, u: [F.lit(kind).alias("source_kind"), key.alias("full_id"), a.alias("via_from"), b.alias("via_to"), t.alias("via_type"), u.alias("unconfirmed"), F.col("_n")]
    out = edges.join(seeds, s & (F.col("from_id") == F.col("_seed"))).select(*cols("statement", F.col("to_id"), F.col("from_id"), F.col("to_id"), F.col("type"), F.col("unconfirmed")))
    into = edges.join(seeds, s & (F.col("to_id") == F.col("_seed")) & (F.col("from_id") != F.col("_seed"))).select(*cols("statement", F.col("from_id"), F.col("from_id"), F.col("to_id"), F.col("type"), F.col("unconfirmed")))
    see = F.lit("see_instead")
    instead = rejections.join(seeds, r & (F.col("full_id") == F.col("_seed"))).select(*cols("statement", F.col("see_instead"), F.col("full_id"), F.col("see_instead"), see, no))
    back = rejections.join(seeds, s & (F.col("see_instead") == F.col("_seed"))).select(*cols("rejection", F.col("full_id"), F.col("full_id"), F.col("see_instead"), see, no))
    found = out.unionByName(into).unionByName(instead).unionByName(back)
    ranks = F.create_map(*[F.lit(x) for pair in C.EDGE_PRIORITY.items() for x in pair])
    priority = F.coalesce(F.try_element_at(ranks, F.col("via_type")), F.lit(0))
    live = records.filter((F.col("source_kind") == "rejection") | T.searchable(F.col("status"))).filter(T.in_namespace(F.col("namespace"), namespace)).select("source_kind", "full_id")
    known = hits.select("source_kind", "full_id")
    fresh = found.join(live, ["source_kind", "full_id"], "left_semi").join(F.broadcast(known) if limit > 0 else known, ["source_kind", "full_id"], "left_anti").withColumn("_p", priority)
    order = ["_p", "_n", "full_id", "source_kind", "via_from", "via_to", "via_type"]
    first = fresh.withColumn("_i", F.row_number().over(Window.partitionBy("source_kind", "full_id").orderBy(*order))).filter("_i = 1")
    most = min(C.GRAPH_NEIGHBOURS, limit) if limit > 0 else C.GRAPH_NEIGHBOURS
    page = first.orderBy(*order).limit(most)
    return page.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).drop("_p", "_n", "_i")
