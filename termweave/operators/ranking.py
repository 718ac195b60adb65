"""Ranking, evaluation against a gold standard, and the ablation of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import ABLATION_MODELS, HIT_RANKS, TOP_K
from ..functions.numeric import clamp, round6
from .scoring import adjustment, blend, components


def _order(score: str, ties: str) -> list[Column]:
    keys = [score, "type_policy_score", "structural_score", "lexical_score", "has_controlled_direct_evidence", "has_real_dbpedia_evidence"]
    return [*[F.desc(k) for k in keys], F.asc("is_weak_constructed_candidate"), F.asc(ties)]


def rank(rows: DataFrame, k: int = TOP_K, ties: str = "place") -> DataFrame:
    """The best k of each reference entity, with their rank; equals in all seven keys keep the order of `ties`."""
    order = Window.partitionBy("reference_entity_id").orderBy(*_order("final_alignment_score", ties))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1")


def sorted_ranks(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy("reference_entity_id", "rank")


def details(ranked: DataFrame, gold: DataFrame, experiment: str, score: str = "final_alignment_score", by: list[str] | None = None, rank_column: str = "rank", ranks=HIT_RANKS) -> DataFrame:
    """A row a gold entity (and value of `by`): candidates, first hit, reciprocal rank, hits at k, the top candidate.

    ranked: at most a few candidates an entity. gold: reference_entity_id, expected (array). Entities that gold
    doesn't have are left out; those without candidates have zeros and empty texts.
    """
    by = by or []
    at = Window.partitionBy(*by, "reference_entity_id").orderBy(rank_column)
    places = ranked.where("reference_entity_id <> ''").withColumn("__at", F.row_number().over(at))
    asked = gold.crossJoin(F.broadcast(ranked.select(*by).distinct())) if by else gold  # the models: a dozen
    rows = asked.join(places.drop("expected"), [*by, "reference_entity_id"], "left")
    hit = F.when(F.array_contains("expected", F.col("candidate_uri")), F.col("__at"))
    first = F.min(hit)
    top = lambda c: F.coalesce(F.max(F.when(F.col("__at") == 1, F.col(c).cast("string"))), F.lit(""))
    out = rows.groupBy(*by, "reference_entity_id").agg(
        F.array_join(F.first("expected"), "|").alias("expected_candidate_uris"),
        F.count("__at").alias("num_candidates"),
        F.coalesce(first, F.lit(0)).alias("first_hit_rank"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("__rr"),
        *[F.coalesce((first <= k).cast("int"), F.lit(0)).alias(f"hit_at_{k}") for k in ranks],
        top("candidate_uri").alias("top1_candidate_uri"),
        top("candidate_label").alias("top1_candidate_label"),
        top(score).alias("top1_score"),
        top(rank_column).alias("top1_rank"),
    )
    return out.withColumn("experiment_name", F.lit(experiment)).withColumn("reciprocal_rank", round6(F.col("__rr")))


def metrics(rows: DataFrame, by: list[str] | None = None, ranks=HIT_RANKS) -> DataFrame:
    """details -> experiment_name (and `by`), metric, value. All shares are of the gold entities."""
    by = ["experiment_name", *(by or [])]
    n = F.count(F.lit(1))
    missing = F.sum((F.col("num_candidates") == 0).cast("int"))
    wide = rows.groupBy(*by).agg(
        *[round6(F.sum(f"hit_at_{k}") / n).alias(f"Precision@{k}") for k in ranks],
        round6(F.sum("__rr") / n).alias("MRR"),
        round6((n - missing) / n).alias("Coverage"),
        n.cast("double").alias("Evaluated references"),
        missing.cast("double").alias("Missing predictions"),
    )
    return wide.unpivot(by, [c for c in wide.columns if c not in by], "metric", "value")


def shown(rows: DataFrame) -> DataFrame:
    """details without the unrounded helper."""
    return rows.drop("__rr")


def models(spark, registry=None) -> DataFrame:
    registry = registry or ABLATION_MODELS
    rows = [(name, *weights, policy) for name, (weights, policy) in registry.items()]
    return spark.createDataFrame(rows, "ablation_model string, w1 double, w2 double, w3 double, w4 double, w5 double, post_policy boolean")


def ablation_ranks(rows: DataFrame, registry=None, k: int = TOP_K, ties: str = "place") -> DataFrame:
    """Featured candidates -> the best k of each model and entity. Component scores are computed once; the models, a
    dozen rows, meet them in one broadcast cross join."""
    scored = components(rows).crossJoin(F.broadcast(models(rows.sparkSession, registry)))
    raw = blend([F.col(f"w{n}") for n in range(1, 6)])
    scored = scored.withColumn("__score", raw)
    scored = scored.withColumn("ablation_score", round6(clamp(F.when(F.col("post_policy"), adjustment(F.col("__score"))).otherwise(F.col("__score")))))
    order = Window.partitionBy("ablation_model", "reference_entity_id").orderBy(*_order("ablation_score", ties))
    ranked = scored.withColumn("ablation_rank", F.row_number().over(order)).where(F.col("ablation_rank") <= k)
    return ranked.drop("__score", "__type", "__kind", "w1", "w2", "w3", "w4", "w5", "post_policy")


def ablation_details(ranked: DataFrame, gold: DataFrame, experiment: str) -> DataFrame:
    return details(ranked, gold, experiment, "ablation_score", ["ablation_model"], "ablation_rank").drop("top1_rank")


def ablation_metrics(ranked: DataFrame, gold: DataFrame, experiment: str) -> DataFrame:
    return metrics(details(ranked, gold, experiment, "ablation_score", ["ablation_model"], "ablation_rank"), ["ablation_model"])
