"""Hierarchical weighted hash tree.

Leaves are shards, joined in racks, joined in regions; a node's weight is the sum
of its leaves'. Each leaf draws -ln(u)/weight from a hash of (key, leaf), and a
node's draw is the least draw below it, which is again an exponential draw with
the node's weight. A row descends by the least draw: region, then rack, then
shard. A changed weight changes the draws of its own path only, so rows move
only out of or into subtrees whose weights change; a new shard takes rows only
into itself.

Law: `key`; doc_id and the shard count decide. Null ids draw as one key of their
own. Slots number a shard's rows from 0 without gaps: rows are counted by
(shard, bucket of the id's hash), offsets are summed over that bounded table,
and each small bucket is numbered by itself, so no task holds a whole shard.
Null text counts as empty; repeated rows are placed alike and get slots of
their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, PER_RACK, RACKS_PER_REGION, BUCKETS = 24, 4, 2, 1024


def tree(n_shards: int, per_rack: int = PER_RACK, racks_per_region: int = RACKS_PER_REGION) -> list[list[list[int]]]:
    """Regions of racks of shard numbers, filled in order; growth appends."""
    racks = [list(range(a, min(a + per_rack, n_shards))) for a in range(0, n_shards, per_rack)]
    return [racks[a : a + racks_per_region] for a in range(0, len(racks), racks_per_region)]


def _draw(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def _least(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def _first(draws: list[Column], found: list[Column], least: Column) -> Column:
    """What stands at the least draw; ties go to the lower node."""
    out = found[-1]
    for d, x in reversed(list(zip(draws[:-1], found[:-1]))):
        out = F.when(d == least, x).otherwise(out)
    return out


def with_shard(df: DataFrame, key: Column, n_shards: int, out: str, weights: dict[int, float] | None = None) -> DataFrame:
    """df with the column out: the leaf that key descends to."""
    w = weights or {}
    kept = df.columns
    nodes = tree(n_shards)
    df = df.select("*", *[_draw(key, s, w.get(s, 1.0)).alias(f"_d{s}") for s in range(n_shards)])
    racks = [(f"_k{i}_{j}", rack) for i, region in enumerate(nodes) for j, rack in enumerate(region)]
    df = df.select("*", *[_least([F.col(f"_d{s}") for s in rack]).alias(name) for name, rack in racks])
    df = df.select("*", *[_least([F.col(f"_k{i}_{j}") for j in range(len(region))]).alias(f"_g{i}") for i, region in enumerate(nodes)])
    df = df.select("*", _least([F.col(f"_g{i}") for i in range(len(nodes))]).alias("_top"))
    in_rack = lambda rack: _first([F.col(f"_d{s}") for s in rack], [F.lit(s) for s in rack], F.col("_top"))
    in_region = lambda i, region: _first([F.col(f"_k{i}_{j}") for j in range(len(region))], [in_rack(r) for r in region], F.col("_top"))
    leaf = _first([F.col(f"_g{i}") for i in range(len(nodes))], [in_region(i, r) for i, r in enumerate(nodes)], F.col("_top"))
    return df.select(*[f"`{c}`" for c in kept], leaf.cast("int").alias(out))


def with_slots(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """df (doc_id, shard, ...) with slot: 0, 1, ... within each shard, by bucket and doc_id."""
    df = df.withColumn("_b", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    cells = df.groupBy("shard", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_b").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    numbered = df.withColumn("_i", F.row_number().over(inside) - 1)
    # starts has shards x buckets rows at most (24,576 here), whatever the input
    return numbered.join(F.broadcast(starts), ["shard", "_b"]).withColumn("slot", F.col("_start") + F.col("_i")).drop("_b", "_i", "_start")


def place(docs: DataFrame, n_shards: int = SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = with_shard(rows, key, n_shards, "shard", weights)
    rows = with_shard(rows, key, n_shards + 1, "grown_shard", weights)
    return with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
