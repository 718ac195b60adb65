"""The engine's queries over the star schema's graph: one for each operator, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numeric as N, similarity as sim, text as T, uri as U
from ..operators import candidates as C, features as E, indexes as I, ranking as R, scoring as S
from ..operators.joins import sized
from ..sources import ntriples, tables
from .graph import Graph, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Candidates that a source gives at most in the capped query; the pipeline's queries use the engine's own cap.
SMALL_CAP = 40
EXPERIMENT = "expanded"


def query(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
    return f


# ---- functions --------------------------------------------------------------------------------------------------


@query
def normalize_text(g: Graph) -> DataFrame:
    n = T.normalize_text(F.col("text"))
    return g.table("documents").select("doc_id", F.md5(n).alias("normalized_md5"), F.length(n).alias("n"))


@query
def normalize_text_index(g: Graph) -> DataFrame:
    n = T.normalize_for_index(F.col("text"))
    return g.table("documents").select("doc_id", F.md5(n).alias("normalized_md5"), F.length(n).alias("n"))


@query
def split_tokens(g: Graph) -> DataFrame:
    words = T.tokens(T.normalize_text(F.col("text")))
    return g.table("conversations").select("conv_id", "turn", F.size(words).cast("long").alias("n_tokens"), F.array_join(words, "|").alias("tokens"))


@query
def simple_stem(g: Graph) -> DataFrame:
    words = g.table("benchmark").select(F.explode(T.tokens(T.normalize_text(F.col("text")))).alias("token")).distinct()
    return words.select("token", T.stem(F.col("token")).alias("stem"))


@query
def normalize_type(g: Graph) -> DataFrame:
    rows = g.raw_terms().select("entity_type").unionByName(g.table("part").select(F.col("p_type").alias("entity_type"))).unionByName(g.table("events").select(F.col("event_type").alias("entity_type")))
    return rows.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).withColumn("normalized", T.normalize_type(F.col("entity_type")))


@query
def uri_last_token(g: Graph) -> DataFrame:
    return g.table("pages").select("page_id", U.last_token(F.col("url")).alias("token"))


def _uris(g: Graph) -> DataFrame:
    r = g.relations()
    parts = [g.labels().select(F.col("resource").alias("uri")), g.types().select(F.col("class").alias("uri")), *[x.select(F.col("property").alias("uri")) for x in r.values()], g.table("pages").select(F.col("url").alias("uri"))]
    return reduce(DataFrame.unionByName, parts).distinct()


@query
def uri_namespace(g: Graph) -> DataFrame:
    return _uris(g).select("uri", U.namespace(F.col("uri")).alias("namespace"))


@query
def uri_kinds(g: Graph) -> DataFrame:
    u = F.col("uri")
    tests = {"is_class": U.is_class, "is_ontology_property": U.is_ontology_property, "is_raw_property": U.is_raw_property, "is_property": U.is_property, "is_resource": U.is_resource}
    return _uris(g).select("uri", *[f(u).cast("int").alias(n) for n, f in tests.items()], E.namespace_feature(u).alias("feature"))


@query
def camel_case_uris(g: Graph) -> DataFrame:
    label = F.col("label")
    n = T.normalize_text(label)
    return g.raw_terms().select(
        "entity_id", T.camel(n).alias("camel"), T.lower_camel(n).alias("lower_camel"), U.class_uri(label).alias("class_uri"),
        U.ontology_property_uri(label).alias("property_uri"), U.raw_property_uri(label).alias("raw_property_uri"), U.resource_uri(label).alias("resource_uri"),
    )


@query
def term_expansion(g: Graph) -> DataFrame:
    return g.terms().select("entity_id", "entity_type", "normalized_label", F.array_join("expanded_terms", "|").alias("expanded_terms"))


def _similarity(g: Graph, name: str, f) -> DataFrame:
    rows = g.pairs().select("id", T.normalize_text(F.col("a")).alias("a"), T.normalize_text(F.col("b")).alias("b"))
    return rows.select("id", N.round6(f(sim.forms(F.col("a")), sim.forms(F.col("b")))).alias(name))


@query
def levenshtein_sim(g: Graph) -> DataFrame:
    return _similarity(g, "levenshtein_sim", sim.levenshtein)


@query
def token_jaccard(g: Graph) -> DataFrame:
    return _similarity(g, "token_jaccard", sim.token_jaccard)


@query
def stem_jaccard(g: Graph) -> DataFrame:
    return _similarity(g, "stem_jaccard", sim.stem_jaccard)


@query
def bigram_jaccard(g: Graph) -> DataFrame:
    return _similarity(g, "bigram_jaccard", sim.bigram_jaccard)


@query
def prefix_sim(g: Graph) -> DataFrame:
    return _similarity(g, "prefix_sim", sim.prefix)


@query
def containment_sim(g: Graph) -> DataFrame:
    return _similarity(g, "containment_sim", sim.containment)


@query
def numeric_functions(g: Graph) -> DataFrame:
    v, p = F.col("value"), F.col("props")
    return g.table("events").select(
        "event_id", N.to_float(p).alias("as_float"), N.to_int(v.cast("string")).alias("as_int"), N.clamp(v / 100.0).alias("clamped"),
        N.round6(N.safe_log(v)).alias("safe_log"), N.round6(N.log_share(v, 10.0)).alias("log_share"), N.round6(N.frequency_bonus(F.abs(v))).alias("bonus"),
    )


# ---- lines ------------------------------------------------------------------------------------------------------


@query
def extract_uris(g: Graph) -> DataFrame:
    found = ntriples.uris(F.col("html"))
    return g.table("pages").select("page_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, "\n")).alias("uris_md5"))


@query
def extract_literal(g: Graph) -> DataFrame:
    return g.table("pages").select("page_id", F.md5(ntriples.literal(F.col("html"))).alias("literal_md5"))


def _parsed(g: Graph, name: str, predicate_as_object: bool = False) -> DataFrame:
    return ntriples.parsers(predicate_as_object)[name](g.lines())


def _parser_queries() -> None:
    for name in ntriples.RELATIONS:
        QUERIES[f"parse_{name}"] = lambda spark, sf_dir, name=name: _parsed(Graph(spark, sf_dir), name)
    QUERIES["parse_types_by_predicate"] = lambda spark, sf_dir: _parsed(Graph(spark, sf_dir), "instance_types", True)


_parser_queries()

# ---- indexes ----------------------------------------------------------------------------------------------------


@query
def label_index(g: Graph) -> DataFrame:
    return I.label_index(g.labels())


@query
def normalized_label_index(g: Graph) -> DataFrame:
    return I.normalized_label_index(g.labels()).select("key", F.array_join("resources", "|").alias("resources"))


@query
def token_index(g: Graph) -> DataFrame:
    return I.resource_token_index(g.labels()).select("key", F.array_join("resources", "|").alias("resources"))


@query
def type_index(g: Graph) -> DataFrame:
    return I.resource_types(g.types()).select("resource", F.array_join("classes", "|").alias("classes"))


@query
def class_instances(g: Graph) -> DataFrame:
    return I.class_instances(g.types()).select("class", F.size("resources").cast("long").alias("n"), F.md5(F.array_join("resources", "|")).alias("resources_md5"))


@query
def entity_property_index(g: Graph) -> DataFrame:
    rows = I.entity_properties(g.relations())
    return rows.select("resource", *[F.array_join(f"{k}_properties", "|").alias(f"{k}_properties") for k in I.KINDS])


@query
def property_frequency(g: Graph) -> DataFrame:
    return I.ordered_frequency(I.property_frequency(g.relations()))


# ---- candidates -------------------------------------------------------------------------------------------------


def _found(g: Graph, cap: int = C.SOURCE_CAP) -> dict[str, DataFrame]:
    return C.find(g.terms(), g.labels(), g.types(), I.property_frequency(g.relations()), cap)


def _shown(rows: DataFrame) -> DataFrame:
    return C.packed(rows.drop("place"))


@query
def candidates_constructed(g: Graph) -> DataFrame:
    return _shown(C.scored(C.find_constructed(g.terms())))


@query
def candidates_labels(g: Graph) -> DataFrame:
    return _shown(C.scored(C.find_in_labels(g.terms(), g.labels())))


@query
def candidates_types(g: Graph) -> DataFrame:
    return _shown(C.scored(C.find_in_types(g.terms(), g.types())))


@query
def candidates_property_theta(g: Graph) -> DataFrame:
    return _shown(C.scored(C.find_in_properties(g.terms(), I.property_frequency(g.relations()))))


@query
def candidates_capped(g: Graph) -> DataFrame:
    """The caps at work: labels and types end with the row that reaches the cap, properties at it."""
    rows = [df.select(F.lit(n).alias("origin"), F.col("entity_id").alias("reference_entity_id"), "candidate_uri", F.col("matched").alias("matched_terms")) for n, df in _found(g, SMALL_CAP).items()]
    return reduce(DataFrame.unionByName, rows)


def _merged(g: Graph) -> DataFrame:
    return C.merged(C.scored(reduce(DataFrame.unionByName, _found(g).values())))


def _top(g: Graph) -> DataFrame:
    """The candidates, at most TOP_K a term: kept, as what follows reads them several times and is planned apart."""
    return C.best_of_each(_merged(g)).cache()


@query
def merge_candidates(g: Graph) -> DataFrame:
    return _shown(_merged(g))


@query
def topk_per_reference(g: Graph) -> DataFrame:
    return _shown(C.best_of_each(_merged(g)))


@query
def candidates_per_reference(g: Graph) -> DataFrame:
    return tables.manifest(C.best_of_each(_merged(g)), "reference_entity_id")


# ---- features and scores ----------------------------------------------------------------------------------------


@query
def type_evidence(g: Graph) -> DataFrame:
    uris = sized(g.labels().select(F.col("resource").alias("uri")).distinct())
    return E.type_evidence(uris, g.types())


@query
def semi_join_evidence(g: Graph) -> DataFrame:
    uris = sized(E.candidate_uris(_top(g)))
    return E.instance_evidence(uris, g.types())


@query
def property_statistics(g: Graph) -> DataFrame:
    uris = g.labels().select(F.col("resource").alias("uri")).distinct()
    facts = E.property_evidence(uris, g.relations(), I.property_frequency(g.relations()))
    return E.with_property_statistics(facts)


def _featured(g: Graph) -> DataFrame:
    return E.features(_top(g), g.types(), g.relations(), I.property_frequency(g.relations())).cache()


@query
def candidate_features(g: Graph) -> DataFrame:
    return _shown(_featured(g))


@query
def component_scores(g: Graph) -> DataFrame:
    flags = ["has_real_dbpedia_evidence", "has_controlled_direct_evidence", "is_weak_constructed_candidate"]
    return S.components(_featured(g)).select("reference_entity_id", "candidate_uri", *S.COMPONENTS, *flags)


def _ranked(g: Graph) -> DataFrame:
    return R.rank(S.final(_featured(g)))


@query
def final_rank(g: Graph) -> DataFrame:
    return _ranked(g).select("reference_entity_id", "rank", "candidate_uri", "candidate_label", "final_alignment_score")


@query
def best_alignments(g: Graph) -> DataFrame:
    return _shown(R.best(_ranked(g)))


# ---- evaluation -------------------------------------------------------------------------------------------------


@query
def evaluation_details(g: Graph) -> DataFrame:
    rows = R.shown(R.details(_ranked(g), tables.gold(g.gold()), EXPERIMENT))
    return rows.withColumn("top1_score", N.to_float(F.col("top1_score")))


@query
def evaluation_metrics(g: Graph) -> DataFrame:
    return R.metrics(R.details(_ranked(g), tables.gold(g.gold()), EXPERIMENT))


@query
def ablation_rankings(g: Graph) -> DataFrame:
    return R.ablation_ranks(_featured(g)).select("ablation_model", "reference_entity_id", "ablation_rank", "candidate_uri", "ablation_score")


@query
def ablation_metrics(g: Graph) -> DataFrame:
    return R.ablation_metrics(R.ablation_ranks(_featured(g)), tables.gold(g.gold()), EXPERIMENT)


@query
def gold_standard(g: Graph) -> DataFrame:
    return tables.gold(g.gold()).select("reference_entity_id", F.array_join("expected", "|").alias("expected"))


@query
def merged_property_sets(g: Graph) -> DataFrame:
    sets = [I.entity_properties({k: v}).select(F.col("resource").alias("uri"), F.col(f"{k}_properties").alias("properties")) for k, v in g.relations().items()]
    return E.merge_properties(*sets).select("uri", F.array_join("properties", "|").alias("properties"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms to ranked alignments."""
    return QUERIES["final_rank"](spark, sf_dir)


__all__ = ["QUERIES", "flagship", "table"]
