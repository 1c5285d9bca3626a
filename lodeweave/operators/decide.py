"""Reranking, calibrated confidence and the three-way decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions import exact, maths, text
from lodeweave.operators import retrieve

#: Weights and intercepts over (top score, margin, support, matches, conflicts) (fixed values).
FUSION_WEIGHTS = (-0.5943875578013758, 0.5522925612468645, -0.8914878659948483, 1.7670971762445122, -0.4187180582858896)
FUSION_INTERCEPT = -1.2868156995143227
HEURISTIC_WEIGHTS = (2.2, 3.0, 0.7, 0.55, -0.9)
HEURISTIC_INTERCEPT = -2.0
#: Thresholds of the decision (fixed values).
MATCH, NO_MATCH, MARGIN, MOST_CONFLICTS = 0.67, 0.32, 0.08, 2


def heuristic_score(query: Column, document: Column) -> Column:
    """Jaccard of words, plus support, matches and conflicts."""
    lexical = maths.jaccard(F.array_distinct(text.words(query)), F.array_distinct(text.words(document)))
    return lexical + 0.18 * (F.col("support") / 3.0) + 0.10 * F.size("matches") - 0.12 * F.size("conflicts")


def rerank(candidates: DataFrame, score: Column) -> DataFrame:
    """New ranks by (score down, fused score down, id up)."""
    order = Window.partitionBy("query_id").orderBy(F.round(F.col("reranker_score"), 10).desc(), F.round("rrf_score", 10).desc(), F.col("doc_id"))
    return candidates.withColumn("reranker_score", score).withColumn("reranker_rank", F.row_number().over(order))


def coverage_penalty(weight: float) -> Column:
    """The fused score, lowered for what of the query a document doesn't cover."""
    return F.col("rrf_score") / (1 + F.lit(weight) * (1 - F.col("coverage")))


def features(queries: DataFrame, candidates: DataFrame, rank: str = "rrf_rank", score: Column | None = None) -> DataFrame:
    """top1_score, margin, source_support, match_count and conflict_count for every query; zeros for one without candidates."""
    score = score if score is not None else F.col("rrf_score") * 20.0 + 0.10 * F.size("matches") - 0.12 * F.size("conflicts")
    scored = candidates.withColumn("_s", score)
    second = F.lead("_s").over(Window.partitionBy("query_id").orderBy(rank))
    best = scored.withColumn("_m", F.col("_s") - F.coalesce(second, F.lit(0.0))).withColumn("_n", F.count("*").over(Window.partitionBy("query_id"))).where(F.col(rank) == 1)
    best = best.select(
        "query_id",
        F.col("doc_id").alias("top_id"),
        F.col("_s").alias("top1_score"),
        F.col("_m").alias("margin"),
        (F.col("support") / 3.0).alias("source_support"),
        F.size("matches").cast("double").alias("match_count"),
        F.size("conflicts").cast("double").alias("conflict_count"),
        F.col("_n").alias("candidates"),
    )
    zero = {n: 0.0 for n in ("top1_score", "margin", "source_support", "match_count", "conflict_count")} | {"candidates": 0}
    return queries.join(best, "query_id", "left").fillna(zero)


#: Sources and structured fields in the order of the feature vector (fixed values).
SOURCES = ("sparse", "dense", "structured")
STRUCTURED = ("year", "collector_number", "series_position", "color", "series")


def feature_vector(logit: Column) -> dict[str, Column]:
    """The 21 features of a candidate by name, in order: its logit, fused score and inverse rank; of each source whether it has
    it and the inverse rank; of each field whether it matches and whether it conflicts; and the shares of both."""
    out = {"logit": logit.cast("double"), "rrf_score": F.col("rrf_score"), "rrf_inverse": 1.0 / F.col("rrf_rank")}
    out |= {f"in_{n}": F.col(f"{n}_rank").isNotNull().cast("double") for n in SOURCES}
    out |= {f"{n}_inverse": F.coalesce(1.0 / F.col(f"{n}_rank"), F.lit(0.0)) for n in SOURCES}
    out |= {f"{n}_{kind}": F.array_contains(kind, n).cast("double") for kind in ("matches", "conflicts") for n in STRUCTURED}
    return out | {"matched": F.size("matches") / 5.0, "conflicting": F.size("conflicts") / 5.0}


def probability(weights: tuple[float, ...] = FUSION_WEIGHTS, intercept: float = FUSION_INTERCEPT) -> Column:
    names = ("top1_score", "margin", "source_support", "match_count", "conflict_count")
    return maths.sigmoid(sum((F.lit(w) * F.col(n) for w, n in zip(weights, names, strict=True)), F.lit(intercept)))


def decide(featured: DataFrame, match: float = MATCH, no_match: float = NO_MATCH, margin: float = MARGIN, conflicts: int = MOST_CONFLICTS, positive: bool = True) -> DataFrame:
    """Adds ``status`` and ``reason``; the order of the rules is part of their meaning. Non-finite confidence fails the query."""
    low = F.col("confidence") < no_match
    if positive:
        low = low | (F.col("top1_score") <= 0)
    finite = F.when(F.isnan("confidence"), F.raise_error("non-finite confidence")).otherwise(F.col("confidence"))
    reason = (
        F.when(F.col("candidates") == 0, "no_candidates")
        .when(low, "no_candidate_above_threshold")
        .when(F.col("conflict_count") > conflicts, "too_many_attribute_conflicts")
        .when(F.col("confidence") < match, "confidence_below_match_threshold")
        .when((F.col("candidates") > 1) & (F.round("margin", 10) < margin), "top1_top2_margin_too_small")
        .otherwise("score_and_margin_above_threshold")
    )
    out = featured.withColumn("confidence", finite).withColumn("reason", reason)
    status = F.when(F.col("reason").isin("no_candidates", "no_candidate_above_threshold"), "no_match").when(F.col("reason") == "score_and_margin_above_threshold", "matched").otherwise("ambiguous")
    return out.withColumn("status", status)


def candidates(signals: DataFrame, catalog: DataFrame, limit: int = retrieve.MOST, embed: Callable = exact.embed) -> DataFrame:
    """Fused candidates of sparse, dense and structured retrieval with their evidence.

    ``embed`` turns a text column into vectors. ``signals`` is read by each retriever, so it should be a table or persisted; many are cut from their plan.
    """
    if not retrieve.few(signals, retrieve.PAIRED_ROWS // 4):
        signals = retrieve.settled(signals, [])
    catalog = retrieve.spread(catalog)
    posted = retrieve.postings(catalog, "doc_id", text.words(F.col("search_text")))
    wanted = signals.select("query_id", F.explode("tokens").alias("token"))
    size = catalog.agg(F.count("*").alias("n"))
    sources = {
        "sparse": retrieve.top(retrieve.sparse(wanted, posted, size), limit),
        "dense": retrieve.dense(signals.select("query_id", embed("normalized_title").alias("vec")), catalog.select("doc_id", embed("search_text").alias("vec")), limit),
        "structured": retrieve.top(retrieve.structured(signals, catalog), limit),
    }
    fused = retrieve.fuse(sources, limit=limit)
    keep = ["query_id", "title", "normalized_title", "year", "collector", "position_text", "color_hints", "series_hints"]
    joined = fused.join(retrieve.comparable_query(signals.select(*keep)), "query_id").join(retrieve.comparable_record(catalog).select("doc_id", "search_text", "release_year", "collector_number", "series_position", "color", "series", "_c_year", "_c_collector", "_c_position", "_c_color", "_c_series"), "doc_id")
    return retrieve.evidence(joined)


def resolve(signals: DataFrame, catalog: DataFrame, embed: Callable = exact.embed) -> DataFrame:
    """The whole path: signals to candidates to confidence to a decision for every query."""
    found = candidates(signals, catalog, embed=embed)
    return decide(features(signals.select("query_id", "title", "expected_id"), found).withColumn("confidence", probability()))
