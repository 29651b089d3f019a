"""Gold set in, comparison of retrieval strategies out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.operators.evaluation import K_VALUES, latency_percentiles, macro_average, query_metrics, refuse_if_all_stale, runs_of
from passagework.operators.rerank import rerank
from passagework.operators.retrieval import dense_search, rrf, sparse_search
from passagework.operators.significance import compare_strategies
from passagework.plans.retrieve import STRATEGIES, Index
from passagework.session import cut
from passagework.sources.reports import write_report


@dataclass(frozen=True)
class Evaluation:
    ranked: DataFrame
    metrics: DataFrame
    averages: DataFrame
    failed: dict[str, str]
    failures: DataFrame | None = None
    latency: DataFrame | None = None

    def compare(self, baseline: str, **options) -> DataFrame:
        return compare_strategies(self.metrics, baseline, **options)


def ranked_by_strategy(queries: DataFrame, index: Index, strategies: Sequence[str] = STRATEGIES, k: int = 10, *,
                       depth: int = 50, candidates: int = 25, scorer=None, stem: bool = True, failed: dict[str, str] | None = None) -> DataFrame:
    """All strategies' rankings side by side.

    Each half is searched once, at the depth of the widest user, and written out; every
    strategy then reads the part it needs. With a dict `failed`, a half or a strategy that fails is noted there for the strategies
    that need it, which are left out; the others stay. It is an error if none is left.
    """
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(sorted(unknown))}")
    hybrid = {"hybrid", "hybrid_rerank"} & set(strategies)
    width = max(depth, k) if hybrid else k
    key = ["query_id", "chunk_id", "chunk_index", "score", "rank"]
    broken: dict[str, str] = {}

    def attempt(name: str, make) -> DataFrame | None:
        """A written frame, or None and a note where it fails and failures are to be listed."""
        try:
            return cut(make())
        except Exception as problem:  # noqa: BLE001
            if failed is None:
                raise
            broken[name] = str(problem)[:4000]
            return None

    # Each half is made by itself: one that fails takes along only the strategies that read it.
    halves: dict[str, DataFrame | None] = {}
    if hybrid or "dense" in strategies:
        halves["dense"] = attempt("dense", lambda: dense_search(queries, index.dense, width))
    if hybrid or "bm25" in strategies:
        halves["sparse"] = attempt("sparse", lambda: sparse_search(queries, index.postings, index.chunks, width, stem))
    reads = {"dense": ["dense"], "bm25": ["sparse"]}
    fused = None
    if hybrid and not broken:
        lists = {name: half.filter(F.col("rank") <= depth) for name, half in halves.items()}
        fused = attempt("fused", lambda: rrf(lists, limit=max(candidates, k)))
    result = None
    for name in strategies:
        lost = [broken[x] for x in reads.get(name, ["dense", "sparse", "fused"]) if x in broken]
        if lost:
            failed[name] = lost[0]
            continue
        if name in reads:
            part = halves[reads[name][0]].filter(F.col("rank") <= k)
        elif name == "hybrid_rerank" and scorer is not None:
            part = attempt(name, lambda: rerank(queries, fused, index.chunks, scorer, k))
            if part is None:
                failed[name] = broken[name]
                continue
        else:
            part = fused.filter(F.col("rank") <= k)
        part = part.select(*key).withColumn("strategy", F.lit(name))
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError(f"every strategy failed: {failed}")
    return result


def evaluate(queries: DataFrame, qrels: DataFrame, index: Index, strategies: Sequence[str] = STRATEGIES, k: int = 10,
             k_values: Sequence[int] = K_VALUES, failures: DataFrame | None = None, latencies: DataFrame | None = None,
             report: str | None = None, **options) -> Evaluation:
    """Runs every strategy over the gold queries and measures it.

    Strategies that fail are listed in `failed` and not measured. `failures` (query_id, strategy) are queries that failed for
    the caller: they are left out of the means and listed. `latencies` (query_id, strategy, took_ms) give percentiles.
    With a path `report`, everything is saved there for `reanalyse`.
    """
    refuse_if_all_stale(qrels, index.chunks)
    failed: dict[str, str] = {}
    ranked = ranked_by_strategy(queries, index, strategies, k, failed=failed, **options)
    if ranked is None:
        raise ValueError(f"every strategy failed: {failed}")
    ran = [s for s in strategies if s not in failed]
    metrics = cut(query_metrics(ranked, qrels, runs_of(qrels, ran, failures), k_values))
    if report is not None:
        write_report(metrics, report, failures, latencies)
    return Evaluation(ranked, metrics, macro_average(metrics), failed, failures, None if latencies is None else latency_percentiles(latencies))
