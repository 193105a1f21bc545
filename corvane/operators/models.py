"""External models as pluggable scorers, run from Arrow batches, with a score cache.

An Embedder maps texts to vectors, a PairScorer maps pairs (premise, hypothesis) to
(entailment, neutral, contradiction). Both are any picklable callable; an HTTP client
is one. Concurrency is partitions times one batch each, so cap it by `tasks`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.records import upserted

Embedder = Callable[[list[str]], list[list[float]]]
PairScorer = Callable[[list[tuple[str, str]]], list[tuple[float, float, float]]]
BATCH, PAIR_BATCH, TASKS = 32, 64, 4


class Unreachable(ConnectionError):
    """The model cannot be reached: what is left of the task is not tried."""


def _tried(batch: list, call: Callable, size: int) -> list[tuple[object, str | None]]:
    """(result, problem) per item; a failed batch is tried again item by item, an unreachable model is given up."""
    out: list[tuple[object, str | None]] = []
    down: str | None = None
    for k in range(0, len(batch), size):
        part = batch[k : k + size]
        if down:
            out += [(None, down)] * len(part)
            continue
        try:
            got = call(part)
            if len(got) != len(part):
                raise ValueError(f"{len(got)} results for {len(part)} items")
            out += [(g, None) for g in got]
        except Unreachable as e:
            down = f"unreachable: {e}"
            out += [(None, down)] * len(part)
        except Exception:
            for item in part:
                try:
                    out.append((call([item])[0], None))
                except Unreachable as e:
                    down = f"unreachable: {e}"
                    out.append((None, down))
                except Exception as e:  # one bad item does not cost its neighbours
                    out.append((None, str(e)[:200]))
    return out


def embedded(records: DataFrame, embedder: Embedder, model: str, tasks: int = TASKS) -> DataFrame:
    """source_kind, full_id, model, dims, vector, source_hash, problem for records with a body; partial success is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = _tried(pdf["body"].tolist(), embedder, BATCH)
            yield pdf.assign(vector=[v for v, _ in got], problem=[p for _, p in got])[["source_kind", "full_id", "body", "vector", "problem"]]

    rows = records.select("source_kind", "full_id", "body").repartition(tasks)
    out = rows.mapInPandas(run, "source_kind string, full_id string, body string, vector array<float>, problem string")
    return out.select("source_kind", "full_id", F.lit(model).alias("model"), F.size("vector").alias("dims"), "vector", F.sha2("body", 256).alias("source_hash"), "problem")


def stored(embeddings: DataFrame, done: DataFrame) -> DataFrame:
    return upserted(embeddings, done.filter("problem is null").drop("problem"), ["source_kind", "full_id", "model"])


def failures(done: DataFrame) -> DataFrame:
    """problem, n: most frequent first."""
    return done.filter("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "problem")


def contradiction(pairs: DataFrame, scorer: PairScorer, identity: str, cache: DataFrame, tasks: int = TASKS) -> tuple[DataFrame, DataFrame]:
    """(the cache with new scores, failures) for pairs (body_a, body_b); only pairs not in the cache are scored. A conflict is symmetric, so the larger of both directions counts."""
    keyed = pairs.select("body_a", "body_b", F.sha2("body_a", 256).alias("a_hash"), F.sha2("body_b", 256).alias("b_hash"))
    own = cache.filter(F.col("identity") == identity)
    new = keyed.join(own.select("a_hash", "b_hash"), ["a_hash", "b_hash"], "left_anti").dropDuplicates(["a_hash", "b_hash"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [p for a, b in zip(pdf["body_a"], pdf["body_b"]) for p in ((a, b), (b, a))]
            got = _tried(both, scorer, PAIR_BATCH)
            score = [max(x[0][2], y[0][2]) if x[1] is None and y[1] is None else None for x, y in zip(got[::2], got[1::2])]
            yield pd.DataFrame({"a_hash": pdf["a_hash"], "b_hash": pdf["b_hash"], "score": score, "problem": [x[1] or y[1] for x, y in zip(got[::2], got[1::2])]})

    done = new.repartition(tasks).mapInPandas(run, "a_hash string, b_hash string, score double, problem string")
    rows = done.filter("score is not null").select(F.lit(identity).alias("identity"), "a_hash", "b_hash", "score")
    return upserted(cache, rows, ["identity", "a_hash", "b_hash"]), failures(done)


def chat_score(top: list[tuple[str, float]]) -> float:
    """The probability of the second of two answers, A and B, from the most likely first tokens and their log-probabilities."""
    found: dict[str, float] = {}
    for token, logprob in top:
        letter = token.strip().lstrip("(")
        if letter in ("A", "B"):
            found.setdefault(letter, logprob)
    if not found:
        raise ValueError("the answer names neither option")
    rest = min(p for _, p in top) - 1  # a letter not listed is less likely than all that are
    return 1 / (1 + math.exp(found.get("A", rest) - found.get("B", rest)))


def first_reachable(models: list[Callable]) -> Callable:
    """One callable that tries models in order and passes on to the next where one cannot be reached."""

    def call(items: list):
        problem: Exception | None = None
        for m in models:
            try:
                return m(items)
            except Unreachable as e:
                problem = e
        raise problem or Unreachable("no model is set up")

    return call
