"""N-Triples lines to relations.

Lines keep their file's order: `seq` numbers them as they are scanned, split by split, without a shuffle. The patterns never
backtrack (possessive), so a literal of any length is safe on the JVM's stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip

URI = "<([^>]*)>"
#: The relations that lines are parsed into.
RELATIONS = ("labels", "instance_types", "literal_properties", "object_properties", "infobox_properties", "sameas_links")
LITERAL = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, seq: text files, compressed or not, without blank lines and comments."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("seq"))
    return rows.withColumn("value", strip(F.col("value"))).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))


def uris(line: Column) -> Column:
    """All <...> of a line, in order."""
    return F.regexp_extract_all(line, F.lit(URI), 1)


def clean_literal(c: Column) -> Column:
    c = F.replace(c, F.lit('\\"'), F.lit('"'))
    for escape in ("\\n", "\\t", "\\r"):
        c = F.replace(c, F.lit(escape), F.lit(" "))
    return strip(c)


def literal(line: Column) -> Column:
    """The first literal without its language or type, escapes of quotes and line ends undone; empty if there is none."""
    return clean_literal(F.regexp_extract(line, LITERAL, 1))


def _columns(**columns: Column) -> Callable[[DataFrame], DataFrame]:
    """A parser: rows where every column has something."""

    def parse(rows: DataFrame) -> DataFrame:
        keep = ["seq"] if "seq" in rows.columns else []
        out = rows.withColumn("__u", uris(F.col("value"))).select(*keep, *[c.alias(n) for n, c in columns.items()])
        for n in columns:
            out = out.where(F.col(n).isNotNull() & ((F.col(n) != "") | F.lit(n not in ("label", "value"))))
        return out

    return parse


def _uri(n: int) -> Column:
    return strip(F.try_element_at("__u", F.lit(n)))


def _text() -> Column:
    return literal(F.col("value"))


def parsers(predicate_as_object: bool = False) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """relation -> parser of lines.

    predicate_as_object: for types and same-as links take a line's second URI, which is the predicate, as results made
    by that reading have it; else its third, the object.
    """
    at = 2 if predicate_as_object else 3
    return {
        "labels": _columns(resource=_uri(1), label=_text()),
        "instance_types": _columns(**{"resource": _uri(1), "class": _uri(at)}),
        "literal_properties": _columns(resource=_uri(1), property=_uri(2), value=_text()),
        "object_properties": _columns(resource=_uri(1), property=_uri(2), object=_uri(3)),
        "infobox_properties": _columns(resource=_uri(1), property=_uri(2), value=_text()),
        "sameas_links": _columns(resource=_uri(1), same_as=_uri(at)),
    }


def preprocess(spark: SparkSession, dumps: dict[str, str], out: Callable[[str], str], predicate_as_object: bool = False, limit: int | None = None) -> DataFrame:
    """dumps: relation -> path. Writes each as Parquet to out(relation); returns relation, status, rows.

    A dump that can't be read is FAILED and doesn't stop the others. limit: lines of each dump, for smoke runs.
    """
    report = []
    for name, parse in parsers(predicate_as_object).items():
        if name not in dumps:
            continue
        try:
            rows = lines(spark, dumps[name])
            rows = parse(rows.limit(limit) if limit else rows)
            rows.write.mode("overwrite").parquet(out(name))
            report.append((name, "OK", spark.read.parquet(out(name)).count()))
        except Exception as e:  # noqa: BLE001  reported, not swallowed
            report.append((name, f"FAILED: {str(e).splitlines()[0][:200]}", 0))
    return spark.createDataFrame(report, "relation string, status string, rows long")
