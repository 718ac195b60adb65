"""Component scores, the final score, and the scores of ablation models. All are projections.

Component scores are rounded before they are blended, as results made elsewhere have them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import COMPONENTS, CONSTRUCTION, CONSTRUCTION_SOURCES, CONTROLLED_SOURCE, CONTROLLED_TOKENS, FINAL_WEIGHTS, REAL_SOURCES
from ..functions import uri as U
from ..functions.numeric import clamp, log_share, round6, to_float
from ..functions.text import normalize_text, normalize_type


def _text(rows: DataFrame, c: str) -> Column:
    """A column of texts joined by a bar, or an array of them, as one text."""
    return F.array_join(c, "|") if dict(rows.dtypes)[c].startswith("array") else F.coalesce(F.col(c), F.lit(""))


def _any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def evidence(rows: DataFrame) -> DataFrame:
    """The three flags: has_real_dbpedia_evidence, has_controlled_direct_evidence, is_weak_constructed_candidate."""
    sources, strategies, matched = _text(rows, "evidence_sources"), _text(rows, "strategies"), normalize_text(_text(rows, "matched_terms"))
    token = normalize_text(U.last_token(F.col("candidate_uri")))
    real = _any(sources, REAL_SOURCES)
    controlled = F.contains(sources, F.lit(CONTROLLED_SOURCE)) | (token.isin(*CONTROLLED_TOKENS) & _any(matched, CONTROLLED_TOKENS))
    seen = reduce(lambda a, b: a | b, [to_float(F.col(c)) > 0 for c in ("total_property_count", "average_property_frequency", "class_instance_count")])
    rows = rows.withColumns({"has_real_dbpedia_evidence": real.cast("int"), "has_controlled_direct_evidence": controlled.cast("int")})
    weak = F.contains(strategies, F.lit(CONSTRUCTION)) & (F.col("has_real_dbpedia_evidence") == 0) & (F.col("has_controlled_direct_evidence") == 0) & ~seen & _any(sources, CONSTRUCTION_SOURCES)
    return rows.withColumn("is_weak_constructed_candidate", weak.cast("int"))


def type_policy() -> Column:
    """From `__type` and `__kind`."""
    table = {
        "class": {"class": 1.0, "resource": 0.35},
        "property": {"ontology_property": 1.0, "raw_property": 0.90, "resource": 0.15},
        "individual": {"resource": 1.0, "class": 0.35},
    }
    cases = [f"WHEN __type = '{t}' AND __kind = '{k}' THEN {v}D" for t, kinds in table.items() for k, v in kinds.items()]
    return F.expr(f"CASE {' '.join(cases)} ELSE 0D END")


def _sum(*parts: tuple[float, Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * c for w, c in parts])


def components(rows: DataFrame) -> DataFrame:
    """rows with the flags and the five component scores."""
    rows = evidence(rows).withColumns({"__type": normalize_type(F.col("reference_entity_type")), "__kind": U.kind(F.col("candidate_uri"))})
    rows = rows.withColumn("__policy", type_policy())
    f = lambda c: to_float(F.col(c))
    controlled, weak, real = F.col("has_controlled_direct_evidence") == 1, F.col("is_weak_constructed_candidate") == 1, F.col("has_real_dbpedia_evidence") == 1
    type_ = F.col("__type")
    # each score stands once in its expression: generated code must not double with every condition
    raised = lambda c, when, by: F.least(c + F.when(when, by).otherwise(0.0), F.when(when, 1.0).otherwise(float("inf")))
    finished = lambda c, factor: round6(clamp(c * F.when(weak, factor).otherwise(1.0)))

    label = _sum((0.24, f("levenshtein_label_similarity")), (0.18, f("token_jaccard_similarity")), (0.14, f("stemmed_jaccard_similarity")), (0.14, f("char_bigram_jaccard_similarity")), (0.10, f("prefix_similarity")), (0.12, f("containment_similarity")), (0.08, f("exact_label_match")))
    token = _sum((0.28, f("uri_levenshtein_similarity")), (0.20, f("uri_token_jaccard_similarity")), (0.14, f("uri_stemmed_jaccard_similarity")), (0.14, f("uri_char_bigram_jaccard_similarity")), (0.10, f("uri_prefix_similarity")), (0.14, f("exact_uri_token_match")))
    exact = (f("exact_label_match") == 1.0) | (f("exact_uri_token_match") == 1.0)
    lexical = finished(raised(0.72 * label + 0.28 * token, exact, 0.06), 0.82)

    policy = F.col("__policy")
    typed = clamp(0.60 * f("has_dbpedia_type") + 0.40 * log_share(f("dbpedia_type_count"), 5.0))
    owned, members = log_share(f("total_property_count"), 8.0), log_share(f("class_instance_count"), 12.0)
    structure = (
        F.when(type_ == "class", _sum((0.62, policy), (0.13, typed), (0.10, owned), (0.15, members)))
        .when(type_ == "property", _sum((0.70, policy), (0.20, owned), (0.10, typed)))
        .when(type_ == "individual", _sum((0.62, policy), (0.23, typed), (0.15, owned)))
        .otherwise(_sum((0.50, policy), (0.20, typed), (0.15, owned), (0.15, members)))
    )
    structural = finished(raised(structure, controlled, 0.12), 0.78)

    mean = f("average_property_frequency")
    balance = F.when(mean <= 0, 0.0).otherwise(1.0 / F.ln(F.greatest(mean, F.lit(0.0)) + 2.0))
    statistical = finished(raised(_sum((0.55, clamp(f("discriminative_property_score"))), (0.25, clamp(balance)), (0.20, owned)), controlled, 0.08), 0.70)

    shares = _sum((0.28, clamp(f("strategy_count") / 5.0)), (0.32, clamp(f("evidence_source_count") / 5.0)), (0.20, clamp(f("average_evidence_weight"))), (0.20, clamp(f("initial_score_numeric"))))
    multisource = finished(raised(raised(shares, real, 0.08), controlled, 0.10), 0.68)

    return rows.withColumns({"lexical_score": lexical, "structural_score": structural, "statistical_score": statistical, "multisource_score": multisource, "type_policy_score": round6(policy)}).drop("__policy")


def adjustment(score: Column) -> Column:
    """The type policy's additions to a blended score; needs `__type`, `__kind` and the flags. Clamp afterwards."""
    type_, kind = F.col("__type"), F.col("__kind")
    steps = [
        ((type_ == "class") & (kind == "class"), 0.08), ((type_ == "class") & (kind == "resource"), -0.05),
        ((type_ == "property") & kind.isin(*U.PROPERTY_KINDS), 0.08), ((type_ == "individual") & (kind == "resource"), 0.08),
        (F.col("has_controlled_direct_evidence") == 1, 0.08), (F.col("is_weak_constructed_candidate") == 1, -0.15),
    ]
    for when, by in steps:
        score = score + F.when(when, by).otherwise(0.0)
    return score


def blend(weights) -> Column:
    return reduce(lambda a, b: a + b, [w * F.col(c) for w, c in zip(weights, COMPONENTS, strict=True)])


def final(rows: DataFrame, weights=FINAL_WEIGHTS) -> DataFrame:
    """rows with flags, component scores and final_alignment_score."""
    rows = components(rows)
    score = blend([F.lit(w) for w in weights])
    return rows.withColumn("__score", score).withColumn("final_alignment_score", round6(clamp(adjustment(F.col("__score"))))).drop("__score", "__type", "__kind")
