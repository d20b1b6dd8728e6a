"""Choice of a search path: exact for small or selective sets, else an index, widened as needed."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.functions.filters import Clause, matches
from quiverlake.operators.hnsw import search_graphs, width
from quiverlake.operators.search import MAX_EF, check_top_k, search

#: Candidates up to which the exact path is taken.
EXACT_LIMIT = 4096
OVERFETCH = 4
ATTEMPTS = 3


def candidate_pool(collection: DataFrame, clauses: Iterable[Clause], limit: int = EXACT_LIMIT) -> int | None:
    """Number of records that pass the most selective eq or in clause, None if more than limit or
    without such a clause. All clauses are counted in one pass."""
    usable = [c for c in clauses if c.op in ("eq", "in")]
    if not usable:
        return None
    counts = collection.agg(*(F.count_if(matches([c])).alias(f"c{i}") for i, c in enumerate(usable))).first()
    least = min(counts)
    return least if least <= limit else None


def plan(collection: DataFrame, clauses: Sequence[Clause], k: int, exact_limit: int = EXACT_LIMIT) -> str:
    """exact or graph."""
    check_top_k(k)
    if clauses and candidate_pool(collection, clauses, exact_limit) is not None:
        return "exact"
    return "exact" if collection.select("id").limit(exact_limit + 1).count() <= exact_limit else "graph"


def planned_search(collection: DataFrame, graphs: DataFrame, query: Sequence[float], k: int, metric: str = "l2", where: Iterable[Clause] = (), ef: int = 0, exact_limit: int = EXACT_LIMIT) -> DataFrame:
    """search by the planned path. A filtered graph search takes OVERFETCH times as many candidates
    on each of ATTEMPTS attempts and falls back to the exact path if fewer than k records pass."""
    if ef > MAX_EF:
        raise ValueError(f"ef must be at most {MAX_EF}")
    clauses = list(where)
    if plan(collection, clauses, k, exact_limit) == "exact":
        return search(collection, query, k, metric, clauses)
    spark = collection.sparkSession
    q = spark.createDataFrame([(0, [float(v) for v in query])], "query_id int, vec array<float>")
    wide = width(ef, k)
    for _ in range(ATTEMPTS if clauses else 1):
        found = search_graphs(q, graphs, min(wide, 1_000_000), metric, wide)
        rows = found.select("id", "score").join(collection.where(matches(clauses)).select("id", "metadata"), "id").orderBy("score", "id").limit(k)
        if not clauses or rows.count() >= k:
            return rows
        wide *= OVERFETCH
    return search(collection, query, k, metric, clauses)
