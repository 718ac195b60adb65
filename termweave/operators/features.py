"""Features of a candidate: similarities to its term, and what the knowledge graph says of its URI."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import similarity as sim, uri as U
from ..functions.numeric import clamp, round6, safe_log, to_float
from ..functions.text import normalize_text
from ..schemas import CANDIDATE_COLUMNS, FEATURE_COLUMNS
from .indexes import tagged
from .joins import sized


def candidate_uris(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.col("candidate_uri").alias("uri")).where("uri is not null and uri <> ''").distinct()


def type_evidence(uris: DataFrame, types: DataFrame) -> DataFrame:
    """uri -> its number of distinct types. A semi-join first: only candidates' facts are aggregated."""
    rows = types.select(F.col("resource").alias("uri"), "class").where("class is not null and class <> ''")
    return rows.join(uris, "uri", "left_semi").groupBy("uri").agg(F.count_distinct("class").alias("dbpedia_type_count"))


def instance_evidence(uris: DataFrame, types: DataFrame) -> DataFrame:
    """uri -> the rows that give it as their class."""
    rows = types.select(F.col("class").alias("uri"), "resource").where("resource is not null and resource <> ''")
    return rows.join(uris, "uri", "left_semi").groupBy("uri").agg(F.count(F.lit(1)).alias("class_instance_count"))


def property_evidence(uris: DataFrame, relations: dict[str, DataFrame], frequency: DataFrame) -> DataFrame:
    """uri -> distinct properties by relation and in all, and the mean frequency (0 for an unknown property, which counts)."""
    facts = tagged(relations).withColumnRenamed("resource", "uri").join(uris, "uri", "left_semi")
    has = lambda k: F.max((F.col("kind") == k).cast("int")).alias(k)
    owned = facts.groupBy("uri", "property").agg(has("literal"), has("object"), has("infobox"))
    owned = owned.join(frequency.select("property", "frequency"), "property", "left")
    return owned.groupBy("uri").agg(
        F.sum("literal").alias("literal_property_count"), F.sum("object").alias("object_property_count"), F.sum("infobox").alias("infobox_property_count"),
        F.count(F.lit(1)).alias("total_property_count"), F.avg(F.coalesce("frequency", F.lit(0))).alias("__average"),
    )


def merge_properties(*parts: DataFrame) -> DataFrame:
    """uri, property sets of several tables -> the united, sorted sets."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("uri").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("properties")))).alias("properties"))


def namespace_feature(uri: Column) -> Column:
    n = U.namespace(uri)
    return F.when(n == "ontology", 1.0).when(n == "property", 0.8).when(n == "resource", 0.6).otherwise(0.0)


def lexical(rows: DataFrame) -> DataFrame:
    """The thirteen similarities and matches; each text is normalized once."""
    token = F.when(F.coalesce("candidate_uri_token", F.lit("")) != "", F.col("candidate_uri_token")).otherwise(U.last_token(F.col("candidate_uri")))
    rows = rows.withColumn("__r", normalize_text(F.col("reference_label"))).withColumn("__l", normalize_text(F.col("candidate_label"))).withColumn("__t", normalize_text(token))
    rows, (r, label, t) = sim.with_forms(rows, "__r", "__l", "__t")
    columns: dict[str, Column] = {}
    for prefix, other in (("", label), ("uri_", t)):
        columns[f"{prefix}levenshtein_similarity" if prefix else "levenshtein_label_similarity"] = round6(sim.levenshtein(r, other))
        columns[f"{prefix}token_jaccard_similarity"] = round6(sim.token_jaccard(r, other))
        columns[f"{prefix}stemmed_jaccard_similarity"] = round6(sim.stem_jaccard(r, other))
        columns[f"{prefix}char_bigram_jaccard_similarity"] = round6(sim.bigram_jaccard(r, other))
        columns[f"{prefix}prefix_similarity"] = round6(sim.prefix(r, other))
    columns["containment_similarity"] = round6(F.greatest(sim.containment(r, label), sim.containment(r, t)))
    columns["exact_label_match"] = (F.col("__r") == F.col("__l")).cast("int")
    columns["exact_uri_token_match"] = (F.col("__r") == F.col("__t")).cast("int")
    return sim.without_forms(rows.withColumns(columns), "__r", "__l", "__t").drop("__r", "__l", "__t")


def with_property_statistics(rows: DataFrame) -> DataFrame:
    """Counts and `__average` -> the statistics of property evidence; rows without evidence have zeros."""
    counts = ("literal_property_count", "object_property_count", "infobox_property_count", "total_property_count")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in counts}).withColumn("__average", F.coalesce("__average", F.lit(0.0)))
    average = F.col("__average")
    return rows.withColumns({
        "log_total_property_count": round6(safe_log(F.col("total_property_count"))),
        "average_property_frequency": round6(average),
        "log_average_property_frequency": round6(safe_log(average)),
        "discriminative_property_score": round6(F.when(average > 0, clamp(1.0 / F.ln(F.greatest(average, F.lit(0.0)) + 2.0))).otherwise(0.0)),
    }).drop("__average")


def features(candidates: DataFrame, types: DataFrame, relations: dict[str, DataFrame], frequency: DataFrame) -> DataFrame:
    """candidates with the 30 feature columns, in their order."""
    uris = sized(candidate_uris(candidates))
    uri = F.col("candidate_uri")
    rows = lexical(candidates)
    for facts in (type_evidence(uris, types), property_evidence(uris, relations, frequency), instance_evidence(uris, types)):
        rows = rows.join(facts, rows["candidate_uri"] == facts["uri"], "left").drop("uri")
    rows = with_property_statistics(rows)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    rows = rows.withColumns({
        "candidate_namespace_feature": namespace_feature(uri),
        "is_dbpedia_ontology_class": flag(U.is_class(uri)),
        "is_dbpedia_resource": flag(U.is_resource(uri)),
        "is_dbpedia_property": flag(U.is_property(uri)),
        "dbpedia_type_count": F.coalesce("dbpedia_type_count", F.lit(0)).cast("int"),
        "class_instance_count": F.coalesce("class_instance_count", F.lit(0)).cast("int"),
        "initial_score_numeric": to_float(F.col("initial_score")),
    }).withColumn("has_dbpedia_type", (F.col("dbpedia_type_count") > 0).cast("int"))
    rows = rows.withColumn("class_instance_log_score", round6(safe_log(F.col("class_instance_count"))))
    rest = [c for c in candidates.columns if c not in CANDIDATE_COLUMNS]
    return rows.select(*CANDIDATE_COLUMNS, *FEATURE_COLUMNS, *rest)
