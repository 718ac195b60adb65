"""Tables in and out: CSV in the dialect of Python's csv module, Parquet between stages, JSON indexes, reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from .. import schemas
from ..config import PILOT_TERMS
from ..functions.text import normalize_text, normalize_type, strip, variants

#: Quotes are doubled and may hold line ends; the empty field is the empty string.
CSV = {"header": True, "escape": '"', "quote": '"', "multiLine": True, "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, required: list[str] | None = None, missing_ok: bool = False) -> DataFrame:
    """Text columns from the header, never inferred, empty for null; with `schema`, its columns in its types.

    A path that isn't there is an error, or with missing_ok the empty relation.
    """
    try:
        rows = spark.read.options(**CSV).csv(path)
    except AnalysisException as e:
        if missing_ok and schema is not None and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    schemas.require(rows, required or (schema.fieldNames() if schema else []), path)
    rows = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])
    if schema is None:
        return rows
    return rows.select(*[F.col(f.name) if isinstance(f.dataType, StringType) else F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A header and all rows; no rows at all is an error, as an empty result is one in every stage."""
    rows = rows.select(*columns) if columns else rows
    if rows.isEmpty():
        raise ValueError(f"no rows for {path}")
    rows.write.mode("overwrite").options(header=True, escape='"', quote='"', encoding="UTF-8").csv(path)


def write_index(rows: DataFrame, path: str, format_: str = "parquet") -> None:
    rows.write.mode("overwrite").format(format_).save(path)


def read_index(spark: SparkSession, path: str, schema: StructType, format_: str = "parquet") -> DataFrame:
    """An index that isn't there is empty."""
    try:
        return spark.read.schema(schema).format(format_).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def copy_table(spark: SparkSession, source: str, target: str) -> None:
    """A CSV input put where an experiment expects it."""
    read_csv(spark, source).write.mode("overwrite").options(header=True, escape='"').csv(target)


def pilot_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*PILOT_TERMS], schemas.REFERENCE_TERMS)


def expand_terms(rows: DataFrame) -> DataFrame:
    """entity_id, entity_type, label -> with normalized_label and expanded_terms; rows without id or label go."""
    schemas.require(rows, ["entity_id", "entity_type", "label"], "the reference terms")
    id_, label = strip(F.coalesce("entity_id", F.lit(""))), strip(F.coalesce("label", F.lit("")))
    rows = rows.select(id_.alias("entity_id"), normalize_type(F.col("entity_type")).alias("entity_type"), label.alias("label"))
    rows = rows.where((F.col("entity_id") != "") & (F.col("label") != ""))
    return rows.withColumn("normalized_label", normalize_text(F.col("label"))).withColumn("expanded_terms", variants(F.col("label")))


def gold(rows: DataFrame) -> DataFrame:
    """reference_entity_id, expected (array, sorted, distinct)."""
    schemas.require(rows, ["reference_entity_id", "expected_candidate_uri"], "the gold standard")
    id_, uri = strip(F.coalesce("reference_entity_id", F.lit(""))), strip(F.coalesce("expected_candidate_uri", F.lit("")))
    rows = rows.select(id_.alias("reference_entity_id"), uri.alias("uri")).where((F.col("reference_entity_id") != "") & (F.col("uri") != ""))
    return rows.groupBy("reference_entity_id").agg(F.array_sort(F.collect_set("uri")).alias("expected"))


def manifest(rows: DataFrame, key: str | None = None) -> DataFrame:
    """What a stage's report tells: its rows, or its rows by `key` (candidates by reference, statuses)."""
    return rows.groupBy(*([key] if key else [])).agg(F.count(F.lit(1)).alias("rows"))
