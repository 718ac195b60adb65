"""Candidate generation: four sources, one projection that scores, a merge and a top-k.

Terms come from sources.tables.expand_terms; relations carry a long `seq` in the order of their file. Every candidate
has a `place` - source, row, tie, number - so that "first" and "ties keep their order" mean the same on any cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import CONSTRUCTION, CONTROLLED_CANDIDATES, CONTROLLED_SOURCE, PROPERTY_THRESHOLD, SOURCE_CAP, TOP_K
from ..functions import similarity as sim, uri as U
from ..functions.numeric import clamp, frequency_bonus, round6
from ..functions.text import camel, lower_camel, normalize_text, stem, strip, tokens
from ..schemas import CANDIDATE_COLUMNS
from .joins import first_up_to, sized

TERM = ["entity_id", "entity_type", "label", "normalized_label", "expanded_terms", "position"]


def positioned(terms: DataFrame) -> DataFrame:
    """Terms with their position, the order in which they are given, if they have none yet."""
    return terms if "position" in terms.columns else terms.withColumn("position", F.monotonically_increasing_id())


def term_variants(terms: DataFrame) -> DataFrame:
    """A row a term and variant."""
    return positioned(terms).select(*TERM, F.posexplode("expanded_terms").alias("variant_at", "variant"))


def _place(source: int, seq: Column, tie: Column, n: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), seq.cast("long").alias("seq"), tie.alias("tie"), n.cast("long").alias("n"))


# ---- scores -----------------------------------------------------------------------------------------------------


def _by_kind(table: dict[str, dict[str, float]]) -> Column:
    """(entity_type, __kind) -> number, 0 if the table has none. One expression, parsed at once."""
    cases = [f"WHEN entity_type = '{t}' AND __kind = '{k}' THEN {v}D" for t, kinds in table.items() for k, v in kinds.items()]
    return F.expr(f"CASE {' '.join(cases)} ELSE 0D END")


def _both(p: float) -> dict[str, float]:
    return dict.fromkeys(U.PROPERTY_KINDS, p)


def type_bonus() -> Column:
    return _by_kind({
        "class": {"class": 0.25, "resource": -0.03} | _both(-0.18),
        "property": _both(0.25) | {"class": -0.20, "resource": -0.10},
        "individual": {"resource": 0.25, "class": -0.02} | _both(-0.18),
    })


def source_weight(base: Column) -> Column:
    moved = _by_kind({
        "class": {"class": 0.15, "resource": -0.08} | _both(-0.15),
        "property": _both(0.15) | {"class": -0.15, "resource": -0.10},
        "individual": {"resource": 0.15} | _both(-0.15),
    })
    return clamp(base + moved, 0.0, 1.30)


def construction_bonus() -> Column:
    """For URIs that only construction found, of the kind that the term asks for."""
    fits = _by_kind({"class": {"class": 0.15}, "property": _both(0.15), "individual": {"resource": 0.15}})
    return F.when(F.col("strategies") == F.array(F.lit(CONSTRUCTION)), fits).otherwise(0.0)


def scored(found: DataFrame) -> DataFrame:
    """Term columns, candidate_uri, candidate_label, strategy and source arrays, matched, weight -> a candidate.

    strategies, evidence_sources and matched_terms stay arrays until they are written.
    """
    type_, uri = F.col("entity_type"), F.col("candidate_uri")
    texts = found.withColumn("__label", normalize_text(F.col("candidate_label"))).withColumn("candidate_uri_token", U.last_token(uri))
    texts = texts.withColumn("__token", normalize_text(F.col("candidate_uri_token")))
    texts = texts.withColumn("__kind", U.kind(uri))
    texts, (reference, label, token) = sim.with_forms(texts, "normalized_label", "__label", "__token")
    weighed = texts.withColumn("__weight", source_weight(F.col("weight")))
    weighed = weighed.withColumn("__lexical", sim.initial(reference, label, token))
    score = clamp(0.64 * F.col("__lexical") + 0.18 * F.col("__weight") + type_bonus() + construction_bonus())
    return weighed.select(
        F.col("entity_id").alias("reference_entity_id"),
        type_.alias("reference_entity_type"),
        F.col("label").alias("reference_label"),
        F.col("normalized_label").alias("reference_normalized_label"),
        F.col("expanded_terms").alias("reference_expanded_terms"),
        "candidate_uri",
        "candidate_label",
        "candidate_uri_token",
        U.namespace(uri).alias("candidate_namespace"),
        "strategies",
        "evidence_sources",
        F.array("matched").alias("matched_terms"),
        round6(F.col("__weight")).alias("average_evidence_weight"),
        round6(score).alias("initial_score"),
        "place",
    )


# ---- sources: what they find is not scored yet ----------------------------------------------------------------------------------------------------


def find_constructed(terms: DataFrame) -> DataFrame:
    """URIs built from the variants; of a term's equal URIs the first counts. No join."""
    v = F.col("variant")

    def spec(uri: Column, label: Column, weight: float, source: str) -> Column:
        return F.struct(uri.alias("candidate_uri"), label.alias("candidate_label"), F.lit(weight).alias("weight"), F.lit(source).alias("source"))

    n = normalize_text(v)
    one = lambda base, name, w: f"named_struct('candidate_uri', '{base}{name}', 'candidate_label', '{name}', 'weight', {w}D, 'source', '{CONTROLLED_SOURCE}')"
    cases = (f"WHEN '{term}' THEN array({', '.join(one(*x) for x in found)})" for term, found in CONTROLLED_CANDIDATES.items())
    none = "cast(array() as array<struct<candidate_uri:string,candidate_label:string,weight:double,source:string>>)"
    controlled = F.expr(f"CASE variant {' '.join(cases)} ELSE {none} END")
    of_property = F.array(
        spec(U.ontology_property_uri(v), lower_camel(n), 1.12, "dbpedia_ontology_property_construction"),
        spec(U.raw_property_uri(v), v, 1.04, "dbpedia_property_construction"),
    )
    specs = (
        F.when(F.col("entity_type") == "class", F.array(spec(U.class_uri(v), camel(n), 1.12, "dbpedia_ontology_class_construction")))
        .when(F.col("entity_type") == "property", F.concat(of_property, controlled))
        .when(F.col("entity_type") == "individual", F.array(spec(U.resource_uri(v), camel(n), 1.10, "dbpedia_resource_construction")))
    )
    rows = term_variants(terms).select(*TERM, "variant_at", "variant", F.posexplode(specs).alias("spec_at", "spec")).select("*", "spec.*").where("candidate_uri <> ''")
    rows = rows.withColumn("place", _place(0, F.col("position"), F.lit(""), F.col("variant_at") * 100 + F.col("spec_at")))
    first = rows.groupBy("entity_id", "candidate_uri").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("entity_id", "candidate_uri")]), "place").alias("r")).select("entity_id", "candidate_uri", "r.*")
    return first.select(*TERM, "candidate_uri", "candidate_label", F.array(F.lit(CONSTRUCTION)).alias("strategies"), F.array("source").alias("evidence_sources"), F.col("variant").alias("matched"), "weight", "place")


def _row_limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """Rows up to the first matching one whose number (seq, from 1) reaches the limit."""
    if limit is None:
        return rows
    last = rows.where(F.col("seq") >= limit).agg(F.min("seq").alias("__end"))
    return rows.join(F.broadcast(last), F.col("seq") <= F.coalesce("__end", F.col("seq"))).drop("__end")  # one row


def find_in_labels(terms: DataFrame, labels: DataFrame, cap: int = SOURCE_CAP, limit: int | None = None) -> DataFrame:
    """Labels, or last tokens of resources, that equal a variant: both keys exploded, then one equi-join."""
    rows = labels.select("seq", strip(F.coalesce("resource", F.lit(""))).alias("candidate_uri"), strip(F.coalesce("label", F.lit(""))).alias("candidate_label"))
    rows = rows.where("candidate_uri <> '' and candidate_label <> ''")
    rows = rows.withColumn("nl", normalize_text(F.col("candidate_label"))).withColumn("nt", normalize_text(U.last_token(F.col("candidate_uri"))))
    keyed = rows.withColumn("matched", F.explode(F.array_distinct(F.array("nl", "nt"))))
    found = keyed.join(sized(term_variants(terms).withColumnRenamed("variant", "matched").drop("variant_at")), "matched")
    in_terms = lambda c: F.array_contains("expanded_terms", F.col(c))
    strategies = F.array_sort(F.array_compact(F.array(
        F.when(F.col("nl") == F.col("normalized_label"), "exact_label"), F.when(in_terms("nl"), "expanded_label"), F.when(in_terms("nt"), "resource_token"),
    )))
    found = found.withColumn("strategies", strategies).withColumn("place", _place(1, F.col("seq"), F.col("matched"), F.col("position")))
    found = first_up_to(_row_limited(found, limit), cap, whole=True)
    return found.select(*TERM, "candidate_uri", "candidate_label", "strategies", F.array(F.lit("dbpedia_labels")).alias("evidence_sources"), "matched", F.lit(0.90).alias("weight"), "place")


def find_in_types(terms: DataFrame, types: DataFrame, cap: int = SOURCE_CAP, limit: int | None = None) -> DataFrame:
    """Instance types whose class or resource name equals a variant: a class for class terms, the resource for individuals."""
    rows = types.select("seq", strip(F.coalesce("resource", F.lit(""))).alias("resource"), strip(F.coalesce("class", F.lit(""))).alias("class"))
    rows = rows.where("resource <> '' and class <> ''")
    rows = rows.withColumn("ct", normalize_text(U.last_token(F.col("class")))).withColumn("rt", normalize_text(U.last_token(F.col("resource"))))
    parts = tokens(F.col("ct"))
    keys = F.concat(F.array("ct", F.array_join(F.transform(parts, stem), " ")), parts, F.array("rt"))
    keyed = rows.withColumn("matched", F.explode(F.array_distinct(F.filter(keys, lambda k: k != ""))))
    wanted = term_variants(terms.where(F.col("entity_type").isin("class", "individual"))).withColumnRenamed("variant", "matched").drop("variant_at")
    found = keyed.join(sized(wanted), "matched")
    of_class = F.col("entity_type") == "class"
    found = found.withColumn("candidate_uri", F.when(of_class, F.col("class")).otherwise(F.col("resource"))).withColumn("place", _place(2, F.col("seq"), F.col("matched"), F.col("position")))
    found = _row_limited(found, limit)
    first = found.groupBy("entity_id", "candidate_uri").agg(F.min_by(F.struct(*[c for c in found.columns if c not in ("entity_id", "candidate_uri")]), "place").alias("r")).select("entity_id", "candidate_uri", "r.*")
    first = first_up_to(first, cap, whole=True)
    strategy = F.when(of_class, "ontology_class_token").otherwise("resource_from_instance_types")
    source = F.when(of_class, "dbpedia_instance_types_classes").otherwise("dbpedia_instance_types_resources")
    weight = F.when(of_class, 0.98).otherwise(0.95)
    return first.select(*TERM, "candidate_uri", U.last_token(F.col("candidate_uri")).alias("candidate_label"), F.array(strategy).alias("strategies"), F.array(source).alias("evidence_sources"), "matched", weight.alias("weight"), "place")


def find_in_properties(terms: DataFrame, frequency: DataFrame, cap: int = SOURCE_CAP, threshold: float = PROPERTY_THRESHOLD) -> DataFrame:
    """Properties whose name is similar to a variant. frequency: property, frequency, first (order among equals).

    A theta join: distinct property names meet the variants of property terms, which are few, in a nested loop. Names
    are few beside facts; the pairs grow with their number alone.
    """
    names = frequency.select("property", "frequency", "first", normalize_text(U.last_token(F.col("property"))).alias("name")).where("name <> ''")
    names, (n,) = sim.with_forms(names, "name")
    wanted, (v,) = sim.with_forms(term_variants(terms.where(F.col("entity_type") == "property")), "variant")
    score = F.greatest(sim.levenshtein(v, n), sim.token_jaccard(v, n), sim.stem_jaccard(v, n), sim.bigram_jaccard(v, n), sim.prefix(v, n))
    pairs = names.join(sized(wanted)).withColumn("score", score).where(F.col("score") >= threshold)
    best = pairs.groupBy("property", "frequency", "first", *TERM).agg(F.max_by("variant", F.struct("score", -F.col("variant_at"))).alias("matched"))
    best = best.orderBy(F.desc("frequency"), "first", "position").limit(cap)
    # at most cap rows
    order = Window.orderBy(F.desc("frequency"), "first", "position")
    best = best.withColumn("place", _place(3, F.row_number().over(order), F.lit(""), F.col("position")))
    return best.select(
        *TERM, F.col("property").alias("candidate_uri"), U.last_token(F.col("property")).alias("candidate_label"),
        F.array(F.lit("property_frequency"), F.lit("property_token")).alias("strategies"),
        F.array(F.lit("dbpedia_properties"), F.lit("dbpedia_property_frequency")).alias("evidence_sources"),
        "matched", (0.82 + frequency_bonus(F.col("frequency"))).alias("weight"), "place",
    )


# ---- merge and top-k --------------------------------------------------------------------------------------------


def merged(candidates: DataFrame) -> DataFrame:
    """One row a term and URI: what was found first describes it, evidence is united, weights averaged, scores maximised."""
    described = [c for c in CANDIDATE_COLUMNS[:9] if c not in ("reference_entity_id", "candidate_uri")]
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    rows = candidates.groupBy("reference_entity_id", "candidate_uri").agg(
        F.min_by(F.struct(*described), "place").alias("d"), united("strategies"), united("evidence_sources"), united("matched_terms"),
        round6(F.avg("average_evidence_weight")).alias("average_evidence_weight"), F.max("initial_score").alias("best"), F.min("place").alias("place"),
    )
    bonus = lambda c: F.least(F.size(c) * 0.04, F.lit(0.20))
    rows = rows.select("*", "d.*").withColumn("initial_score", round6(F.least(F.col("best") + bonus("strategies") + bonus("evidence_sources"), F.lit(1.0))))
    rows = rows.withColumn("strategy_count", F.size("strategies")).withColumn("evidence_source_count", F.size("evidence_sources"))
    return rows.select(*CANDIDATE_COLUMNS, "place")


def best_of_each(candidates: DataFrame, k: int = TOP_K) -> DataFrame:
    order = Window.partitionBy("reference_entity_id").orderBy(F.desc("initial_score"), F.desc("evidence_source_count"), F.desc("strategy_count"), "place")
    return candidates.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def find(terms: DataFrame, labels: DataFrame, types: DataFrame, frequency: DataFrame, cap: int = SOURCE_CAP) -> dict[str, DataFrame]:
    """What each source finds, in the order of the sources."""
    return {
        "constructed": find_constructed(terms),
        "labels": find_in_labels(terms, labels, cap),
        "types": find_in_types(terms, types, cap),
        "properties": find_in_properties(terms, frequency, cap),
    }


def generate(terms: DataFrame, labels: DataFrame, types: DataFrame, frequency: DataFrame, k: int = TOP_K, cap: int = SOURCE_CAP) -> DataFrame:
    """All four sources, scored in one projection, merged, the best k a term."""
    return best_of_each(merged(scored(reduce(DataFrame.unionByName, find(terms, labels, types, frequency, cap).values()))), k)


def packed(rows: DataFrame) -> DataFrame:
    """Arrays as text joined by a bar, for files."""
    return rows.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])
