"""A small knowledge graph from the star schema, so that the engine's queries run on any tables of that form.

Every relation carries `seq`, the order in which its rows would stand in a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import ONTOLOGY, PROPERTY, RESOURCE
from ..sources.tables import expand_terms

#: Labels of property terms, as an ontology would name them.
PROPERTY_TERMS = ("name", "brand", "size", "nation", "region", "part", "hasMaker", "purchase", "country", "viewed by")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resource(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{RESOURCE}{kind}_"), F.col(key).cast("string"))


def class_of(c: str) -> Column:
    return F.concat(F.lit(ONTOLOGY), F.initcap(F.lower(c)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Graph:
    """The relations, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._terms: DataFrame | None = None
        self.sf_dir = sf_dir
        self._kept: dict[str, object] = {}

    def table(self, name: str) -> DataFrame:
        return self._once(f"table {name}", lambda: table(self.spark, self.sf_dir, name))

    def _once(self, name: str, make):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    def labels(self) -> DataFrame:
        named = [("part", "Part", "p_partkey", "p_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("region", "Region", "r_regionkey", "r_name"), ("supplier", "Supplier", "s_suppkey", "s_name"), ("customer", "Customer", "c_custkey", "c_name")]
        return _union([self.table(t).select((F.col(k).cast("long") * 10 + n).alias("seq"), resource(kind, k).alias("resource"), F.col(c).alias("label")) for n, (t, kind, k, c) in enumerate(named)])

    def types(self) -> DataFrame:
        part, customer = self.table("part"), self.table("customer")
        return _union([
            part.select((F.col("p_partkey") * 10).alias("seq"), resource("Part", "p_partkey").alias("resource"), class_of("p_type").alias("class")),
            customer.select((F.col("c_custkey") * 10 + 4).alias("seq"), resource("Customer", "c_custkey").alias("resource"), class_of("c_mktsegment").alias("class")),
        ])

    def relations(self) -> dict[str, DataFrame]:
        return self._once("relations", self._relations)

    def _relations(self) -> dict[str, DataFrame]:
        def facts(t: str, n: int, kind: str, key: str, base: str, name, value: Column, order: Column | None = None) -> DataFrame:
            p = F.concat(F.lit(base), name if isinstance(name, Column) else F.lit(name))
            return self.table(t).select(((order if order is not None else F.col(key).cast("long")) * 100 + n).alias("seq"), resource(kind, key).alias("resource"), p.alias("property"), value.cast("string").alias("v"))

        literal = [
            facts("part", 1, "Part", "p_partkey", PROPERTY, "name", F.col("p_name")),
            facts("part", 2, "Part", "p_partkey", PROPERTY, "brand", F.col("p_brand")),
            facts("part", 3, "Part", "p_partkey", PROPERTY, "size", F.col("p_size")),
            facts("supplier", 4, "Supplier", "s_suppkey", PROPERTY, "name", F.col("s_name")),
        ]
        objects = [
            facts("customer", 5, "Customer", "c_custkey", ONTOLOGY, "nation", resource("Nation", "c_nationkey")),
            facts("supplier", 6, "Supplier", "s_suppkey", ONTOLOGY, "nation", resource("Nation", "s_nationkey")),
            facts("nation", 7, "Nation", "n_nationkey", ONTOLOGY, "region", resource("Region", "n_regionkey")),
            facts("lineitem", 8, "Order", "l_orderkey", ONTOLOGY, "part", resource("Part", "l_partkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")),
        ]
        infobox = [facts("events", 9, "User", "user_id", PROPERTY, F.col("event_type"), F.col("value"), F.col("event_id"))]
        return {"literal": _union(literal).withColumnRenamed("v", "value"), "object": _union(objects).withColumnRenamed("v", "object"), "infobox": _union(infobox).withColumnRenamed("v", "value")}

    def raw_terms(self) -> DataFrame:
        """Classes and individuals named in the data, and the fixed property terms."""
        of = lambda t, c, kind: self.table(t).select(F.lit(kind).alias("entity_type"), F.col(c).alias("label"))
        named = _union([of("part", "p_type", "Class"), of("customer", "c_mktsegment", "concept"), of("region", "r_name", "individual"), of("nation", "n_name", "Instance"), of("part", "p_name", "individual")])
        fixed = self.spark.createDataFrame([("objectProperty", p) for p in PROPERTY_TERMS], "entity_type string, label string")
        rows = named.unionByName(fixed).where("label is not null").distinct()
        return rows.withColumn("entity_id", F.concat(F.lit("ref:"), F.lower("entity_type"), F.lit(":"), "label"))

    def terms(self) -> DataFrame:
        """The expanded terms; their position is their place by id, among the few there are."""
        if self._terms is None:  # read by every source of candidates
            self._terms = expand_terms(self.raw_terms()).withColumn("position", F.row_number().over(Window.orderBy("entity_id"))).cache()
        return self._terms

    def gold(self) -> DataFrame:
        """reference_entity_id, expected_candidate_uri: what the data say; several for a name that several parts share."""
        of = lambda t, c, kind, uri: self.table(t).select(F.concat(F.lit(f"ref:{kind}:"), c).alias("reference_entity_id"), uri.alias("expected_candidate_uri"))
        data = _union([
            of("part", "p_type", "class", class_of("p_type")), of("customer", "c_mktsegment", "concept", class_of("c_mktsegment")),
            of("region", "r_name", "individual", resource("Region", "r_regionkey")), of("nation", "n_name", "instance", resource("Nation", "n_nationkey")),
            of("part", "p_name", "individual", resource("Part", "p_partkey")),
        ])
        fixed = [("name", PROPERTY), ("brand", PROPERTY), ("size", PROPERTY), ("nation", ONTOLOGY), ("region", ONTOLOGY), ("part", ONTOLOGY), ("purchase", PROPERTY), ("colour", PROPERTY)]
        props = self.spark.createDataFrame([(f"ref:objectproperty:{p}", base + p) for p, base in fixed], "reference_entity_id string, expected_candidate_uri string")
        return data.unionByName(props).distinct()

    def lines(self) -> DataFrame:
        """The graph as N-Triples lines: labels, types, facts, infobox values, and links to the same thing elsewhere."""
        uri = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
        line = lambda *parts: F.concat(F.concat_ws(" ", *parts), F.lit(" ."))
        quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
        relations = self.relations()
        named = self.labels().select("seq", line(uri(F.col("resource")), F.lit("<http://www.w3.org/2000/01/rdf-schema#label>"), F.concat(quoted(F.col("label")), F.lit("@en"))).alias("value"))
        typed = self.types().select("seq", line(uri(F.col("resource")), F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"), uri(F.col("class"))).alias("value"))
        literal = relations["literal"].select("seq", line(uri(F.col("resource")), uri(F.col("property")), F.concat(quoted(F.col("value")), F.lit("^^<http://www.w3.org/2001/XMLSchema#string>"))).alias("value"))
        objects = relations["object"].select("seq", line(uri(F.col("resource")), uri(F.col("property")), uri(F.col("object"))).alias("value"))
        boxes = relations["infobox"].select("seq", line(uri(F.col("resource")), uri(F.col("property")), quoted(F.col("value"))).alias("value"))
        same = self.labels().select("seq", line(uri(F.col("resource")), F.lit("<http://www.w3.org/2002/07/owl#sameAs>"), uri(F.concat(F.lit("http://example.org/same/"), F.md5("resource")))).alias("value"))
        return _union([named, typed, literal, objects, boxes, same])

    def pairs(self) -> DataFrame:
        """id, a, b: neighbouring names and whole benchmark texts, to compare."""

        def of(t: str, k: str, c: str, source: str) -> DataFrame:
            rows = self.table(t).select(F.col(k).cast("long").alias("k"), F.col(c).alias("c"))
            left, right = rows.select("k", F.col("c").alias("a")), rows.select((F.col("k") - 1).alias("k"), F.col("c").alias("b"))
            return left.join(right, "k").select(F.concat(F.lit(source), F.col("k").cast("string")).alias("id"), "a", "b")

        return _union([of("part", "p_partkey", "p_name", "p"), of("nation", "n_nationkey", "n_name", "n"), of("region", "r_regionkey", "r_name", "r"), of("benchmark", "item_id", "text", "b")])
