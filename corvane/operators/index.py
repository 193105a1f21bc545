"""A positional index of records, kept in tables and refreshed before a read.

The index is a list of segments under one folder. A segment holds the records that
one refresh added or changed: `docs` (keys, digest, length, tokens in order, shard),
`postings` (a row per term and shard of SHARD records: an array of record, length,
frequency and positions, with the count, the largest frequency and the least length
beside it), `df` (by how much document frequencies changed) and `dead` (keys whose
older rows no longer hold). Postings and frequencies are dealt over BUCKETS by term,
so a request reads its terms' buckets, and in them only row groups that may hold the
terms. Each task orders its records by namespace: one shard's words are alike.

A segment is written where its records are: a task sorts bodies, makes their tokens and
writes `docs`; another turns the shards of one docs file into postings, a row per term
and shard, sorted in the task. Neither bodies nor tokens nor postings are shuffled.

A refresh compares digests, so it tokenises only what changed; small segments are
merged, by sizes, without tokenising. A version is one small file naming segments and
totals, written last: readers see the old version or the new one, and a refresh that
was lost leaves nothing but a folder that no version names (vacuum() deletes those).
One writer at a time; a second one fails at the version file.

The best k need no score of every record: a shard's bound is the sum of its terms'
largest weights; PROBE shards of the highest bounds are scored first, and only shards
whose bound reaches the k-th best score found are scored at all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions.porter import stem
from corvane.operators import lexical
from corvane.sources import shared

BUCKETS, SHARD, PROBE, SEGMENTS = 64, 128, 8, 8
KEY = ["source_kind", "full_id"]
BLOCK = "source_kind string, shard bigint, term string, n int, max_tf int, min_dl int, records array<struct<full_id:string,dl:int,tf:int,positions:array<int>>>"
TABLES = {
    "docs": "source_kind string, full_id string, namespace string, digest string, dl int, shard bigint, terms array<string>",
    "postings": f"{BLOCK}, bucket int",
    "df": "source_kind string, term string, df bigint, bucket int",
    "dead": "source_kind string, full_id string",
    "changes": "source_kind string, full_id string, change string",
}  # what a table without rows has no file to say
AT_ONCE = 2048  # records, about, that a task turns into postings at once
SLACK = 1e-6  # sums of doubles in another order


def stemmed_terms(rows: DataFrame) -> DataFrame:
    """rows with every word of terms stemmed; each distinct word of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("terms")
            words = b.column(i).flatten().dictionary_encode()
            stems = pa.array([stem(w) if w else w for w in words.dictionary.to_pylist()], pa.string())
            offsets = b.column(i).offsets
            if len(offsets) and offsets[0].as_py():  # a slice of a longer array
                offsets = pa.compute.subtract(offsets, offsets[0])
            yield b.set_column(i, "terms", pa.ListArray.from_arrays(offsets, stems.take(words.indices)))

    return rows.mapInArrow(run, rows.schema)


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in their order, about AT_ONCE together, cut only where a shard ends."""
    held = []
    for b in batches:
        for i in range(0, len(b), AT_ONCE):
            t = pa.Table.from_batches([*held, b.slice(i, AT_ONCE)])
            shards = t.column("shard").to_numpy()
            others = np.flatnonzero(shards != shards[-1])
            end = int(others[-1]) + 1 if len(others) else 0
            if end:
                yield t.slice(0, end)
            held = t.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def inverted(docs: DataFrame) -> DataFrame:
    """BLOCK rows of docs rows as they lie in their files; a shard that two tasks read has a row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_shards(batches):
            kinds, ids, dl, shards = (t.column(c).combine_chunks() for c in ("source_kind", "full_id", "dl", "shard"))
            lists = t.column("terms").combine_chunks()
            lengths = lists.value_lengths().to_numpy()
            words = lists.flatten().dictionary_encode()
            term = words.indices.to_numpy().astype(np.int64)
            kind, dl_, shard = kinds.dictionary_encode().indices.to_numpy(), dl.to_numpy(), shards.to_numpy()
            new = np.ones(len(t), dtype=bool)  # a record given twice counts as one
            new[1:] = (kind[1:] != kind[:-1]) | (dl_[1:] != dl_[:-1]) | (shard[1:] != shard[:-1]) | pa.compute.not_equal(ids.slice(1), ids.slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            record = np.repeat(np.cumsum(new) - 1, lengths)
            pos = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            _, group = np.unique((shard - shard[0]) * (int(kind.max()) + 1) + kind, return_inverse=True)
            key = np.repeat(group, lengths) * len(words.dictionary) + term
            is_word = np.flatnonzero(pa.compute.not_equal(words.dictionary, lexical.GAP).to_numpy(zero_copy_only=False)[term])
            order = is_word[np.lexsort((pos[is_word], record[is_word], key[is_word]))]
            if not len(order):
                continue
            key, record, pos = key[order], record[order], pos[order]
            held = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (record[1:] != record[:-1])])  # where a record's positions begin
            tf = np.diff(np.r_[held, len(key)]).astype(np.int32)
            at = first[record[held]]  # the row of each
            block = np.flatnonzero(np.r_[True, np.diff(key[held]) != 0])
            offsets = lambda begins, n: pa.array(np.r_[begins, n].astype(np.int32))
            positions = pa.ListArray.from_arrays(offsets(held, len(key)), pa.array(pos.astype(np.int32)))
            records = pa.StructArray.from_arrays([ids.take(pa.array(at)), dl.take(pa.array(at)), pa.array(tf), positions], ["full_id", "dl", "tf", "positions"])
            row = at[block]
            yield pa.RecordBatch.from_arrays(
                [
                    kinds.take(pa.array(row)), shards.take(pa.array(row)), words.dictionary.take(pa.array(term[order[held[block]]])), pa.array(np.diff(np.r_[block, len(held)]).astype(np.int32)),
                    pa.array(np.maximum.reduceat(tf, block)), pa.array(np.minimum.reduceat(dl_[at], block)), pa.ListArray.from_arrays(offsets(block, len(held)), records),
                ],
                ["source_kind", "shard", "term", "n", "max_tf", "min_dl", "records"],
            )

    return docs.select(*KEY, "dl", "shard", "terms").mapInArrow(run, BLOCK)


def bucket_of(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def _weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * dl / avgdl))


class Index:
    """The index under root; stemmed or by plain words."""

    def __init__(self, spark: SparkSession, root: str, stemmed: bool = True):
        self.spark, self.root, self.stemmed = spark, root.rstrip("/"), stemmed
        self.pruned: dict[str, int] = {}

    # ---- versions and tables -------------------------------------------------------------------------------

    def version(self) -> dict:
        """number, segments ([segment, rows, dead rows]) and totals ({kind: [rows, tokens]}) of the newest version."""
        held = [n for n in shared.names(self.spark, f"{self.root}/versions") if n.endswith(".json")]
        if not held:
            return {"number": 0, "segments": [], "totals": {}, "next": 1}
        return shared.get_json(self.spark, f"{self.root}/versions/{held[-1]}")

    def _commit(self, old: dict, segments: list, totals: dict, next_: int) -> None:
        number = old["number"] + 1
        totals = {k: [int(n), int(t)] for k, (n, t) in totals.items() if n}
        shared.put_json(self.spark, f"{self.root}/versions/{number:09d}.json", {"number": number, "segments": segments, "totals": totals, "next": next_})

    def _at(self, segment: int, table: str) -> str:
        return f"{self.root}/segments/{segment:06d}/{table}"

    def _table(self, segment: int, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(self._at(segment, table))

    def _read(self, version: dict, table: str) -> DataFrame | None:
        """A table of all segments, with their numbers; dead tables only where there are dead rows."""
        parts = [self._table(s, table).withColumn("segment", F.lit(s)) for s, _, dead in version["segments"] if table != "dead" or dead]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _living(self, version: dict, rows: DataFrame) -> DataFrame:
        """rows (with KEY and segment) that no later segment declares dead."""
        dead = self._read(version, "dead")
        if dead is None:
            return rows
        last = dead.groupBy(*KEY).agg(F.max("segment").alias("_last"))
        return rows.join(last, (rows["source_kind"] == last["source_kind"]) & (rows["full_id"] == last["full_id"]) & (last["_last"] > rows["segment"]), "left_anti")

    def docs(self, version: dict) -> DataFrame | None:
        every = self._read(version, "docs")
        return None if every is None else self._living(version, every)

    # ---- writing -------------------------------------------------------------------------------------------

    def _write(self, segment: int, rows: DataFrame, made=lambda rows: rows) -> None:
        """docs and postings of rows (KEY, namespace, digest; made() adds dl and terms once they are in order)."""
        shard = F.lit(segment << 44) + F.expr(f"monotonically_increasing_id() div {SHARD}")
        docs = made(rows.sortWithinPartitions("namespace", *KEY)).withColumn("shard", shard)
        docs.select(*KEY, "namespace", "digest", "dl", "shard", "terms").write.parquet(self._at(segment, "docs"), compression="zstd")
        out = inverted(self._table(segment, "docs")).withColumn("bucket", _bucket(F.col("term")))
        out.sortWithinPartitions("bucket", "term", "source_kind", "shard").write.partitionBy("bucket").parquet(self._at(segment, "postings"), compression="zstd")

    def _tokenised(self, rows: DataFrame) -> DataFrame:
        out = lexical.tokenised(rows).select(*KEY, "namespace", "digest", "dl", "terms")
        return stemmed_terms(out) if self.stemmed else out

    def _write_df(self, segment: int, changes: DataFrame) -> None:
        """changes: source_kind, term, df."""
        df = changes.groupBy("source_kind", "term").agg(F.sum("df").alias("df")).filter("df <> 0").withColumn("bucket", _bucket(F.col("term")))
        df.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(self._at(segment, "df"))

    def refresh(self, records: DataFrame) -> dict[str, int]:
        """Bring the index up to records (KEY, namespace, body, tags); how many were added, updated, removed, unchanged."""
        old = self.version()
        segment = old["next"]
        tags = F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "\u0000")
        digest = F.sha2(F.concat_ws("\u0001", "namespace", tags, "body"), 256)
        shared.remove(self.spark, f"{self.root}/segments/{segment:06d}")  # of a refresh that was lost
        was = self.docs(old)
        gone = None
        if was is None:  # all is new: nothing to compare
            fresh = records
        else:
            now, was = records.select(*KEY, digest.alias("_now")), was.select(*KEY, F.col("digest").alias("_was"))
            change = F.when(F.col("_was").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_was") != F.col("_now"), "updated").otherwise("unchanged")
            now.join(was, KEY, "full_outer").select(*KEY, change.alias("change")).write.partitionBy("change").parquet(self._at(segment, "changes"))
            diff = self._table(segment, "changes")
            counts = {r.change: r["count"] for r in diff.groupBy("change").count().collect()}
            if set(counts) <= {"unchanged"}:
                return counts
            fresh = records.join(diff.filter(F.col("change").isin("added", "updated")).select(*KEY), KEY, "left_semi")
            gone = diff.filter(F.col("change").isin("updated", "removed")).select(*KEY)
        if records.groupBy(*KEY).count().filter("count > 1").limit(1).count():
            fresh = fresh.repartition(*KEY)  # the rows of one key make one record, so one task must have them
        self._write(segment, fresh.withColumn("digest", digest), self._tokenised)
        if was is None:
            counts = {"added": n} if (n := self._table(segment, "docs").count()) else {}
            if not counts:
                return counts
        mine = self._table(segment, "postings").select("source_kind", "term", F.col("n").cast("long").alias("df"))
        sign = self._table(segment, "docs").select("source_kind", "dl", F.lit(1).alias("sign"))
        dead = counts.get("updated", 0) + counts.get("removed", 0)
        if dead:
            gone.write.parquet(self._at(segment, "dead"))
            lost = self.docs(old).join(gone, KEY, "left_semi")
            mine = mine.unionByName(lost.select("source_kind", F.explode(F.array_distinct("terms")).alias("term"), F.lit(-1).cast("long").alias("df")).filter(F.col("term") != lexical.GAP))
            sign = sign.unionByName(lost.select("source_kind", "dl", F.lit(-1).alias("sign")))
        self._write_df(segment, mine)
        totals = {k: list(v) for k, v in old["totals"].items()}
        for r in sign.groupBy("source_kind").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("dl")).alias("t")).collect():
            n, t = totals.get(r.source_kind, [0, 0])
            totals[r.source_kind] = [n + r.n, t + r.t]
        self._commit(old, [*old["segments"], [segment, counts.get("added", 0) + counts.get("updated", 0), dead]], totals, segment + 1)
        if len(old["segments"]) >= SEGMENTS:
            self.merge()
        return counts

    def merge(self, whole: bool = False) -> None:
        """Make the newest segments one: all, or the last two and older ones while those are at most twice as large as what is merged."""
        old = self.version()
        held = old["segments"]
        first = 0 if whole else max(len(held) - 2, 0)
        while first and held[first - 1][1] <= 2 * sum(n for _, n, _ in held[first:]):
            first -= 1
        some, segment = held[first:], old["next"]
        if len(some) < 2 and not (whole and some and some[0][2]):
            return
        part = old | {"segments": some}
        shared.remove(self.spark, f"{self.root}/segments/{segment:06d}")
        # small segments lie in many files, so here, and only here, records are dealt anew
        self._write(segment, self.docs(part).drop("segment", "shard").repartitionByRange("namespace", "full_id"))
        self._write_df(segment, self._read(part, "df").select("source_kind", "term", "df"))
        dead = self._read(part, "dead")
        older = dead is not None and first > 0
        if older:
            dead.select(*KEY).distinct().write.parquet(self._at(segment, "dead"))
        rows = self._table(segment, "docs").count()
        self._commit(old, [*held[:first], [segment, rows, sum(d for *_, d in some) if older else 0]], old["totals"], segment + 1)

    def vacuum(self) -> list[str]:
        """Delete segments that the newest version does not name, and all older versions; no reader may still be at one."""
        now = self.version()
        keep = {f"{s:06d}" for s, *_ in now["segments"]}
        gone = [f"segments/{n}" for n in shared.names(self.spark, f"{self.root}/segments") if n not in keep]
        gone += [f"versions/{n}" for n in shared.names(self.spark, f"{self.root}/versions") if n != f"{now['number']:09d}.json"]
        for x in gone:
            shared.remove(self.spark, f"{self.root}/{x}")
        return gone

    # ---- reading -------------------------------------------------------------------------------------------

    def blocks(self, version: dict, words: list[str]) -> DataFrame:
        """Postings rows of words: only their buckets and terms are read."""
        hit = F.col("bucket").isin(sorted({bucket_of(w) for w in words})) & F.col("term").isin(sorted(set(words)))
        return self._read(version, "postings").filter(hit)

    def hits(self, version: dict, words: list[str], shards: DataFrame | list | None = None) -> DataFrame:
        """KEY, segment, shard, dl, term, tf, positions of living records that hold a word, in some shards or all."""
        rows = self.blocks(version, words)
        if isinstance(shards, list):
            rows = rows.filter(F.col("shard").isin(shards))
        elif shards is not None:
            rows = rows.join(shards.select("source_kind", "shard"), ["source_kind", "shard"], "left_semi")
        return self._living(version, rows.select("source_kind", "segment", "shard", "term", F.inline("records")))

    def phrase_hits(self, version: dict, phrase: list[str], shards: DataFrame | list | None = None) -> DataFrame:
        """KEY, shard, dl, term (the phrase), tf of living records where the words of a phrase follow each other."""
        rows = self.hits(version, phrase, shards)
        at = lambda i: rows.filter(F.col("term") == phrase[i])
        out = at(0).select(*KEY, "segment", "shard", "dl", F.col("positions").alias("_p"))
        for i in range(1, len(phrase)):
            more = at(i).select(*KEY, F.transform("positions", lambda p: p - i).alias("_q"))  # noqa: B023
            out = out.join(more, KEY).withColumn("_p", F.array_intersect("_p", "_q")).drop("_q")
        return out.filter(F.size("_p") > 0).select(*KEY, "shard", "dl", F.lit(" ".join(phrase)).alias("term"), F.size("_p").alias("tf"))

    def counts(self, phrases: list[list[str]]) -> dict[str, dict]:
        """What lexical.corpus_counts says, from stored totals and frequencies; phrases of several words are counted by their positions."""
        version = self.version()
        out = {k: {"n": n, "avgdl": t / n, "token": {}} for k, (n, t) in version["totals"].items()}
        words = sorted({w for p in phrases for w in p})
        if not out or not words:
            return out
        hit = F.col("bucket").isin(sorted({bucket_of(w) for w in words})) & F.col("term").isin(words)
        held = self._read(version, "df").filter(hit).select("source_kind", "term", "df")
        longer = sorted({tuple(p) for p in phrases if len(p) > 1})
        for p in longer:
            held = held.unionByName(self.phrase_hits(version, list(p)).select("source_kind", "term", F.lit(1).cast("long").alias("df")))
        for r in held.groupBy("source_kind", "term").agg(F.sum("df").alias("df")).collect():  # a row per kind and phrase of the draft
            if r.source_kind in out and r.df:
                out[r.source_kind]["token"][r.term] = r.df
        for c in out.values():
            c["phrase"] = [c["token"].get(" ".join(p), 0) if p else 0 for p in phrases]
        return out

    def _asked(self, phrases: list[list[str]], counts: dict[str, dict]) -> tuple[DataFrame, list[str], list[list[str]]]:
        """(source_kind, term, idf, avgdl; single words; longer phrases) of the fields that count."""
        idf = lambda c, i: max(math.log((c["n"] - c["phrase"][i] + 0.5) / (c["phrase"][i] + 0.5)), C.BM25_LEAST_IDF)
        rows: dict[tuple[str, str], float] = {}
        kept = set()
        for kind, c in sorted(counts.items()):
            for i in lexical.kept_fields(phrases, c):
                if phrases[i]:
                    kept.add(tuple(phrases[i]))
                    rows[kind, " ".join(phrases[i])] = rows.get((kind, " ".join(phrases[i])), 0.0) + idf(c, i)
        table = self.spark.createDataFrame([(k, t, x, float(counts[k]["avgdl"])) for (k, t), x in sorted(rows.items())], "source_kind string, term string, idf double, avgdl double")
        return F.broadcast(table), sorted(p[0] for p in kept if len(p) == 1), [list(p) for p in sorted(kept) if len(p) > 1]

    def scores(self, phrases: list[list[str]], counts: dict[str, dict], shards: DataFrame | list | None = None) -> DataFrame:
        """source_kind, full_id, score, as lexical.bm25 gives them, from the index alone."""
        version = self.version()
        asked, words, longer = self._asked(phrases, counts)
        parts = [self.hits(version, words, shards).select(*KEY, "dl", "term", "tf")] if words else []
        parts += [self.phrase_hits(version, p, shards).select(*KEY, "dl", "term", "tf") for p in longer]
        if not parts or not version["segments"]:
            return self.spark.createDataFrame([], "source_kind string, full_id string, score double")
        found = reduce(DataFrame.unionByName, parts).join(asked, ["source_kind", "term"])
        return found.groupBy(*KEY).agg(F.sum(F.col("idf") * _weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))

    def bounds(self, phrases: list[list[str]], counts: dict[str, dict]) -> DataFrame:
        """source_kind, shard, bound: no record of the shard scores more."""
        version = self.version()
        asked, words, longer = self._asked(phrases, counts)
        parts = [self.blocks(version, words).select("source_kind", "shard", "term", F.col("max_tf").alias("tf"), F.col("min_dl").alias("dl"))] if words else []
        parts += [self.phrase_hits(version, p).groupBy("source_kind", "shard", "term").agg(F.max("tf").alias("tf"), F.min("dl").alias("dl")) for p in longer]
        found = reduce(DataFrame.unionByName, parts).join(asked, ["source_kind", "term"])
        return found.groupBy("source_kind", "shard").agg(F.sum(F.col("idf") * _weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("bound"))

    def top(self, phrases: list[list[str]], counts: dict[str, dict], eligible: DataFrame, k: int, report: bool = False) -> DataFrame:
        """source_kind, full_id, score, pos: the best k of each kind among eligible records (KEY), by score at 9 digits, then full_id.

        With report, `pruned` says how many shards hold a term and how many of them were scored.
        """
        if not self.version()["segments"] or not any(phrases):
            return self.spark.createDataFrame([], "source_kind string, full_id string, score double, pos int")
        bounds = self.bounds(phrases, counts)
        order = [F.desc(F.round("score", 9)), "full_id"]
        best = lambda rows: rows.join(eligible.select(*KEY), KEY, "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("source_kind").orderBy(*order))).filter(F.col("pos") <= k)
        probe = bounds.withColumn("_i", F.row_number().over(Window.partitionBy("source_kind").orderBy(F.desc("bound"), "shard"))).filter(F.col("_i") <= PROBE)
        first = [r.shard for r in probe.select("shard").distinct().collect()]  # PROBE a kind
        least = {r.source_kind: r.score for r in best(self.scores(phrases, counts, first)).filter(F.col("pos") == k).collect()}  # one a kind
        enough = reduce(lambda a, b: a & b, [(F.col("source_kind") != kind) | (F.col("bound") >= score - SLACK) for kind, score in least.items()], F.lit(True))
        kept = bounds.filter(enough)
        if report:
            r = bounds.agg(F.count(F.lit(1)).alias("shards"), F.count_if(enough).alias("scored")).first()
            self.pruned = {"shards": r.shards, "scored": r.scored}
        return best(self.scores(phrases, counts, kept))
