"""Indexes of the knowledge graph, as aggregations. Relations carry `seq`, any ordered column, for first and last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.text import normalize_for_index, strip
from ..functions.uri import last_token


def _filled(rows: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        rows = rows.withColumn(c, strip(F.coalesce(F.col(c), F.lit(""))))
    return reduce(lambda r, c: r.where(F.col(c) != ""), columns, rows)


def label_index(labels: DataFrame) -> DataFrame:
    """resource -> its last label."""
    rows = _filled(labels, "resource", "label").where(normalize_for_index(F.col("label")) != "")
    return rows.groupBy("resource").agg(F.max_by("label", "seq").alias("label"))


def _in_order(rows: DataFrame, key: str) -> DataFrame:
    """key -> resources in the order of seq, repeats kept. A key's list is the index entry itself."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "resource"))).alias("r"))
    return lists.select(key, F.transform("r", lambda x: x["resource"]).alias("resources"))


def normalized_label_index(labels: DataFrame) -> DataFrame:
    rows = _filled(labels, "resource", "label").withColumn("key", normalize_for_index(F.col("label"))).where("key <> ''")
    return _in_order(rows, "key")


def resource_token_index(labels: DataFrame) -> DataFrame:
    """Normalized last token of the URI -> resources; the label may be empty."""
    rows = _filled(labels, "resource").withColumn("key", normalize_for_index(last_token(F.col("resource")))).where("key <> ''")
    return _in_order(rows, "key")


def resource_types(types: DataFrame) -> DataFrame:
    return _filled(types, "resource", "class").groupBy("resource").agg(F.array_sort(F.collect_set("class")).alias("classes"))


def class_instances(types: DataFrame) -> DataFrame:
    return _filled(types, "resource", "class").groupBy("class").agg(F.array_sort(F.collect_set("resource")).alias("resources"))


#: The three relations of properties, in their order.
KINDS = ("literal", "object", "infobox")


def tagged(relations: dict[str, DataFrame]) -> DataFrame:
    """resource, property, kind, kind_at, seq of all property relations."""
    parts = [_filled(relations[k], "property").select(strip(F.coalesce("resource", F.lit(""))).alias("resource"), "property", F.lit(k).alias("kind"), F.lit(n).alias("kind_at"), "seq") for n, k in enumerate(KINDS) if k in relations]
    return reduce(DataFrame.unionByName, parts)


def entity_properties(relations: dict[str, DataFrame]) -> DataFrame:
    """resource -> its distinct properties by relation, sorted."""
    rows = tagged(relations).where("resource <> ''")
    sets = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("property")))).alias(f"{k}_properties") for k in KINDS]
    return rows.groupBy("resource").agg(*sets)


def property_frequency(relations: dict[str, DataFrame]) -> DataFrame:
    """property, frequency (rows, not distinct ones), position (1 for the most frequent; ties as first seen)."""
    counts = tagged(relations).groupBy("property").agg(F.count(F.lit(1)).alias("frequency"), F.min(F.struct("kind_at", "seq")).alias("first"))
    return counts


def ordered_frequency(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("frequency"), "first").select("property", "frequency")


def build_all(labels: DataFrame, types: DataFrame, relations: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The index registry: name -> index."""
    return {
        "label_index": label_index(labels),
        "normalized_label_index": normalized_label_index(labels),
        "resource_type_index": resource_types(types),
        "class_instance_index": class_instances(types),
        "entity_property_index": entity_properties(relations),
        "property_frequency_index": ordered_frequency(property_frequency(relations)),
        "resource_token_index": resource_token_index(labels),
    }
