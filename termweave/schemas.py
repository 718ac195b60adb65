"""Schemas of the relations, declared once; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _of(kind, names: str) -> list[StructField]:
    return [StructField(n, kind, True) for n in names.split()]


def strings(names: str) -> StructType:
    return StructType(_of(StringType(), names))


LABELS = strings("resource label")
INSTANCE_TYPES = strings("resource class")
LITERAL_PROPERTIES = strings("resource property value")
OBJECT_PROPERTIES = strings("resource property object")
INFOBOX_PROPERTIES = strings("resource property value")
SAMEAS_LINKS = strings("resource same_as")
REFERENCE_TERMS = strings("entity_id entity_type label")
GOLD = strings("reference_entity_id reference_label expected_candidate_uri relation")
PROPERTY_FREQUENCY = StructType([StructField("property", StringType()), StructField("frequency", LongType())])

CANDIDATE = StructType(
    _of(
        StringType(),
        "reference_entity_id reference_entity_type reference_label reference_normalized_label reference_expanded_terms "
        "candidate_uri candidate_label candidate_uri_token candidate_namespace strategies evidence_sources matched_terms",
    )
    + _of(IntegerType(), "strategy_count evidence_source_count")
    + _of(DoubleType(), "average_evidence_weight initial_score")
)
CANDIDATE_COLUMNS = CANDIDATE.fieldNames()
FEATURE_COLUMNS = (
    "levenshtein_label_similarity token_jaccard_similarity stemmed_jaccard_similarity char_bigram_jaccard_similarity prefix_similarity "
    "uri_levenshtein_similarity uri_token_jaccard_similarity uri_stemmed_jaccard_similarity uri_char_bigram_jaccard_similarity "
    "uri_prefix_similarity containment_similarity exact_label_match exact_uri_token_match candidate_namespace_feature "
    "is_dbpedia_ontology_class is_dbpedia_resource is_dbpedia_property has_dbpedia_type dbpedia_type_count literal_property_count "
    "object_property_count infobox_property_count total_property_count log_total_property_count average_property_frequency "
    "log_average_property_frequency discriminative_property_score class_instance_count class_instance_log_score initial_score_numeric"
).split()
SCORE_COLUMNS = (
    "lexical_score structural_score statistical_score multisource_score type_policy_score final_alignment_score "
    "has_real_dbpedia_evidence has_controlled_direct_evidence is_weak_constructed_candidate"
).split()


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return df
