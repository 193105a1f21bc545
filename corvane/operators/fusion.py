"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C

KEY = ["source_kind", "full_id"]


def ranked(rows: DataFrame, list_name: str, kind: str, order: list, cap: int = 0) -> DataFrame:
    """KEY, list, kind, similarity, pos of one list, best first; cap 0 keeps all."""
    similarity = F.col("similarity") if "similarity" in rows.columns else F.lit(None).cast("double")
    numbered = rows.select(*KEY, F.lit(list_name).alias("list"), F.lit(kind).alias("kind"), similarity.alias("similarity"), F.row_number().over(Window.partitionBy(F.lit(list_name)).orderBy(*order)).alias("pos"))
    return numbered.filter(F.col("pos") <= cap) if cap else numbered


def scan_cap(limit: int) -> int:
    return 0 if limit == 0 else max(100, 10 * limit)


def fuse(lists: DataFrame, limit: int = 0) -> DataFrame:
    """KEY, score, match_kind, similarity, best first: sum of 1 / (RRF_K + pos); one order however the lists were scored."""
    kinds = F.array_sort(F.collect_set("kind"))
    out = lists.groupBy(*KEY).agg(F.sum(1.0 / (C.RRF_K + F.col("pos"))).alias("score"), kinds.alias("_k"), F.max("similarity").alias("similarity"))
    out = out.select(*KEY, "score", F.when(F.size("_k") > 1, "both").otherwise(F.col("_k")[0]).alias("match_kind"), "similarity")
    out = out.orderBy(F.desc(F.round("score", 12)), "full_id", "source_kind")
    return out.limit(limit) if limit else out
