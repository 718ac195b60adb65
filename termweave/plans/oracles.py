"""The same queries in SQL, written from the definitions and apart from the engine, for a second opinion."""

from __future__ import annotations

from ..config import (
    ABLATION_MODELS, CONSTRUCTION, CONSTRUCTION_SOURCES, CONTROLLED_CANDIDATES, CONTROLLED_SOURCE, CONTROLLED_TOKENS, FINAL_WEIGHTS, HIT_RANKS,
    MAX_VARIANTS, ONTOLOGY, PROPERTY, PROPERTY_PREFIXES, REAL_SOURCES, RESOURCE, SOURCE_CAP, STEM_SUFFIXES, STOP_WORDS, SYNONYMS, TOP_K, TYPE_NAMES,
)
from .graph import PROPERTY_TERMS
from .queries import EXPERIMENT, SMALL_CAP


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(map(q, values))


def d(x: float) -> str:
    return f"{x!r}::DOUBLE"


# ---- functions --------------------------------------------------------------------------------------------------


def norm(e: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace(coalesce({e}, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def norm_index(e: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower(coalesce({e}, '')), '_', ' '), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(n: str) -> str:
    return f"list_filter(string_split({n}, ' '), lambda w_: w_ <> '')"


def stem(t: str) -> str:
    cases = []
    for s in STEM_SUFFIXES:
        cut = f"left({t}, length({t}) - {len(s)})" + (" || 'y'" if s == "ies" else "")
        cases.append(f"WHEN ends_with({t}, '{s}') AND length({t}) > {len(s) + 2} THEN {cut}")
    return f"CASE {' '.join(cases)} ELSE {t} END"


def stemmed(n: str) -> str:
    return f"list_transform({words(n)}, lambda s_: {stem('s_')})"


def last(u: str) -> str:
    return f"regexp_extract(regexp_replace(coalesce({u}, ''), '[/#]+$', ''), '[^/#]*$')"


def namespace(u: str) -> str:
    return f"CASE WHEN coalesce({u}, '') = '' THEN 'unknown' WHEN contains({u}, '/resource/') THEN 'resource' WHEN contains({u}, '/ontology/') THEN 'ontology' WHEN contains({u}, '/property/') THEN 'property' ELSE 'other' END"


def feature(u: str) -> str:
    return f"CASE {namespace(u)} WHEN 'ontology' THEN 1.0::DOUBLE WHEN 'property' THEN 0.8::DOUBLE WHEN 'resource' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END"


def _initial(u: str) -> str:
    return f"left({last(u)}, 1)"


def is_class(u: str) -> str:
    return f"(starts_with({u}, '{ONTOLOGY}') AND upper({_initial(u)}) = {_initial(u)} AND lower({_initial(u)}) <> {_initial(u)})"


def is_oprop(u: str) -> str:
    return f"(starts_with({u}, '{ONTOLOGY}') AND lower({_initial(u)}) = {_initial(u)} AND upper({_initial(u)}) <> {_initial(u)})"


def is_rprop(u: str) -> str:
    return f"starts_with({u}, '{PROPERTY}')"


def is_prop(u: str) -> str:
    return f"({is_oprop(u)} OR {is_rprop(u)})"


def is_res(u: str) -> str:
    return f"starts_with({u}, '{RESOURCE}')"


def type_name(e: str) -> str:
    n = norm(e)
    return "CASE " + " ".join(f"WHEN {n} IN ({names(v)}) THEN '{k}'" for k, v in TYPE_NAMES.items()) + f" WHEN {n} = '' THEN 'unknown' ELSE {n} END"


def capital(w: str) -> str:
    return f"upper(left({w}, 1)) || substr({w}, 2)"


def camel(n: str) -> str:
    return f"list_aggregate(list_transform({words(n)}, lambda c_: {capital('c_')}), 'string_agg', '')"


def camel0(n: str) -> str:
    return f"coalesce({camel(n)}, '')"


def lower_camel(n: str) -> str:
    rest = f"list_transform(list_slice({words(n)}, 2, 1000), lambda c_: {capital('c_')})"
    return f"coalesce({words(n)}[1], '') || coalesce(list_aggregate({rest}, 'string_agg', ''), '')"


def named(base: str, name: str) -> str:
    return f"CASE WHEN {name} = '' THEN '' ELSE '{base}' || {name} END"


def levenshtein(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))::DOUBLE END"


def jaccard(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y})))::DOUBLE END"


def bigrams(n: str) -> str:
    s = f"replace({n}, ' ', '')"
    return f"CASE WHEN length({s}) = 0 THEN []::VARCHAR[] WHEN length({s}) = 1 THEN [{s}] ELSE list_transform(range(1, length({s})), lambda i_: substr({s}, i_, 2)) END"


def prefix(a: str, b: str) -> str:
    short = f"least(length({a}), length({b}))"
    return f"CASE WHEN {short} = 0 THEN 0.0::DOUBLE ELSE len(list_filter(range(1, {short} + 1), lambda i_: left({a}, i_) = left({b}, i_)))::DOUBLE / {short}::DOUBLE END"


def containment(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b}))::DOUBLE ELSE 0.0::DOUBLE END"


def token_jaccard(a: str, b: str) -> str:
    return jaccard(words(a), words(b))


def stem_jaccard(a: str, b: str) -> str:
    return jaccard(stemmed(a), stemmed(b))


def bigram_jaccard(a: str, b: str) -> str:
    return jaccard(f"({bigrams(a)})", f"({bigrams(b)})")


def clamp(e: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"greatest({d(low)}, least({e}, {d(high)}))"


def safe_log(e: str) -> str:
    return f"CASE WHEN ({e}) <= 0 THEN 0.0::DOUBLE ELSE ln(greatest(({e})::DOUBLE, 0.0) + 1.0) END"


def log_share(e: str, full: float) -> str:
    return f"CASE WHEN ({e}) <= 0 THEN 0.0::DOUBLE ELSE {clamp(f'ln(greatest(({e})::DOUBLE, 0.0) + 1.0) / {d(full)}')} END"


def unique(e: str) -> str:
    """A list without repeats, in order."""
    return f"list_filter({e}, lambda x_, i_: list_position({e}, x_) = i_)"


def r6(e: str) -> str:
    return f"round({e}, 6)"


# ---- the graph --------------------------------------------------------------------------------------------------

_LABELS = " UNION ALL ".join(
    f"SELECT {k}::BIGINT * 10 + {n} AS seq, '{RESOURCE}{kind}_' || {k}::VARCHAR AS resource, {c} AS label FROM {t}"
    for n, (t, kind, k, c) in enumerate([("part", "Part", "p_partkey", "p_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("region", "Region", "r_regionkey", "r_name"), ("supplier", "Supplier", "s_suppkey", "s_name"), ("customer", "Customer", "c_custkey", "c_name")])
)


def _class(c: str) -> str:
    return f"'{ONTOLOGY}' || upper(left({c}, 1)) || lower(substr({c}, 2))"


_TYPES = (
    f"SELECT p_partkey * 10 AS seq, '{RESOURCE}Part_' || p_partkey::VARCHAR AS resource, {_class('p_type')} AS class FROM part"
    f" UNION ALL SELECT c_custkey * 10 + 4, '{RESOURCE}Customer_' || c_custkey::VARCHAR, {_class('c_mktsegment')} FROM customer"
)


def _facts(t: str, n: int, kind: str, key: str, prop: str, value: str, order: str | None = None) -> str:
    return f"SELECT ({order or key})::BIGINT * 100 + {n} AS seq, '{RESOURCE}{kind}_' || {key}::VARCHAR AS resource, {prop} AS property, ({value})::VARCHAR AS v FROM {t}"


_LITERAL = " UNION ALL ".join([
    _facts("part", 1, "Part", "p_partkey", q(PROPERTY + "name"), "p_name"), _facts("part", 2, "Part", "p_partkey", q(PROPERTY + "brand"), "p_brand"),
    _facts("part", 3, "Part", "p_partkey", q(PROPERTY + "size"), "p_size"), _facts("supplier", 4, "Supplier", "s_suppkey", q(PROPERTY + "name"), "s_name"),
])
_OBJECT = " UNION ALL ".join([
    _facts("customer", 5, "Customer", "c_custkey", q(ONTOLOGY + "nation"), f"'{RESOURCE}Nation_' || c_nationkey::VARCHAR"),
    _facts("supplier", 6, "Supplier", "s_suppkey", q(ONTOLOGY + "nation"), f"'{RESOURCE}Nation_' || s_nationkey::VARCHAR"),
    _facts("nation", 7, "Nation", "n_nationkey", q(ONTOLOGY + "region"), f"'{RESOURCE}Region_' || n_regionkey::VARCHAR"),
    _facts("lineitem", 8, "Order", "l_orderkey", q(ONTOLOGY + "part"), f"'{RESOURCE}Part_' || l_partkey::VARCHAR", "l_orderkey * 10 + l_linenumber"),
])
_INFOBOX = _facts("events", 9, "User", "user_id", f"'{PROPERTY}' || event_type", "value", "event_id")
_TAGGED = " UNION ALL ".join(f"SELECT resource, property, '{k}' AS kind, {n} AS kind_at, seq FROM {k}_facts WHERE property <> ''" for n, k in enumerate(("literal", "object", "infobox")))
_FREQUENCY = "SELECT property, count(*)::BIGINT AS frequency, min(kind_at::HUGEINT * 1000000000000000 + seq) AS first FROM tagged GROUP BY property"

_RAW_TERMS = (
    "SELECT DISTINCT 'ref:' || lower(entity_type) || ':' || label AS entity_id, entity_type, label FROM ("
    "SELECT 'Class' AS entity_type, p_type AS label FROM part UNION ALL SELECT 'concept', c_mktsegment FROM customer UNION ALL SELECT 'individual', r_name FROM region"
    " UNION ALL SELECT 'Instance', n_name FROM nation UNION ALL SELECT 'individual', p_name FROM part UNION ALL "
    + " UNION ALL ".join(f"SELECT 'objectProperty', {q(p)}" for p in PROPERTY_TERMS)
    + ") WHERE label IS NOT NULL"
)
_SYNONYMS = "MAP {" + ", ".join(f"{q(k)}: [{names(v)}]" for k, v in SYNONYMS.items()) + "}"
_PREFIXES = ", ".join(f"CASE WHEN starts_with(n, {q(p)}) THEN trim(substr(n, {len(p) + 1})) END" for p in PROPERTY_PREFIXES)

#: name -> (its SQL, what it needs)
CTE: dict[str, tuple[str, str]] = {
    "kg_labels": (_LABELS, ""),
    "kg_types": (_TYPES, ""),
    "literal_facts": (_LITERAL, ""),
    "object_facts": (_OBJECT, ""),
    "infobox_facts": (_INFOBOX, ""),
    "tagged": (_TAGGED, "literal_facts object_facts infobox_facts"),
    "frequency": (_FREQUENCY, "tagged"),
    "raw_terms": (_RAW_TERMS, ""),
    "term_words": (f"SELECT *, {words('n')} AS w FROM (SELECT *, {norm('label')} AS n FROM raw_terms)", "raw_terms"),
    "term_stems": (f"SELECT *, list_filter(w, lambda t: length(t) > 2) AS long, list_transform(list_filter(w, lambda t: length(t) > 2), lambda t: {stem('t')}) AS st, list_filter(w, lambda t: NOT (t IN ({names(STOP_WORDS)}))) AS content FROM term_words", "term_words"),
    "term_parts": (
        f"SELECT *, list_filter(list_concat([n, n, {_PREFIXES}], long, st, [array_to_string(st, ' '), array_to_string(content, ' ')], content), lambda x: x IS NOT NULL AND x <> '') AS parts FROM term_stems",
        "term_stems",
    ),
    "term_own": (f"SELECT *, {unique('parts')} AS own FROM term_parts", "term_parts"),
    "term_all": (
        f"SELECT *, list_concat(own, flatten(list_transform(flatten(list_transform(own, lambda v: list_concat([v], {words('v')}))), lambda k: coalesce({_SYNONYMS}[k], []::VARCHAR[])))) AS everything FROM term_own",
        "term_own",
    ),
    "terms": (
        f"SELECT entity_id, {type_name('entity_type')} AS entity_type, trim(label) AS label, n AS normalized_label, list_slice({unique('everything')}, 1, {MAX_VARIANTS}) AS expanded, row_number() OVER (ORDER BY entity_id) AS position FROM term_all WHERE trim(label) <> ''",
        "term_all",
    ),
    "variants": ("SELECT t.*, i AS variant_at, expanded[i] AS variant FROM terms t, range(1, 1 + len(t.expanded)) AS r(i)", "terms"),
}


def sql(body: str, needs: str) -> str:
    """body with the common tables that it needs, each before what needs it."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for x in CTE[name][1].split():
                add(x)
            order.append(name)

    for name in needs.split():
        add(name)
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTE[n][0]})" for n in order) + " " if order else "") + body


# ---- candidates -------------------------------------------------------------------------------------------------


def _kinds(type_: str, u: str, table: list[tuple[str, list[tuple]]]) -> str:
    return "CASE " + " ".join(f"WHEN {type_} = '{t}' AND {test(u)} THEN {d(v)}" for t, cases in table for test, v in cases) + " ELSE 0.0::DOUBLE END"


_BONUS = [("class", [(is_class, 0.25), (is_res, -0.03), (is_prop, -0.18)]), ("property", [(is_prop, 0.25), (is_class, -0.20), (is_res, -0.10)]), ("individual", [(is_res, 0.25), (is_class, -0.02), (is_prop, -0.18)])]
_MOVED = [("class", [(is_class, 0.15), (is_res, -0.08), (is_prop, -0.15)]), ("property", [(is_prop, 0.15), (is_class, -0.15), (is_res, -0.10)]), ("individual", [(is_res, 0.15), (is_prop, -0.15)])]


def _scored(found: str) -> str:
    """entity columns, candidate_uri, candidate_label, strategies, sources, matched (lists; text), weight, source, seq, tie, n -> candidates."""
    lexical = r6(
        f"{d(0.25)} * ({levenshtein('normalized_label', 'cl')}) + {d(0.20)} * ({token_jaccard('normalized_label', 'cl')}) + {d(0.15)} * ({stem_jaccard('normalized_label', 'cl')})"
        f" + {d(0.15)} * ({bigram_jaccard('normalized_label', 'cl')}) + {d(0.10)} * ({prefix('normalized_label', 'cl')}) + {d(0.10)} * ({levenshtein('normalized_label', 'ct')}) + {d(0.05)} * ({token_jaccard('normalized_label', 'ct')})"
    )
    u = "candidate_uri"
    fits = f"(entity_type = 'class' AND {is_class(u)}) OR (entity_type = 'property' AND {is_prop(u)}) OR (entity_type = 'individual' AND {is_res(u)})"
    built = f"CASE WHEN strategies = ['{CONSTRUCTION}'] AND ({fits}) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""
    SELECT entity_id AS reference_entity_id, entity_type AS reference_entity_type, label AS reference_label, normalized_label AS reference_normalized_label,
           array_to_string(expanded, '|') AS reference_expanded_terms, candidate_uri, candidate_label, candidate_uri_token, {namespace(u)} AS candidate_namespace,
           strategies, sources AS evidence_sources, [matched] AS matched_terms, round(w, 6) AS average_evidence_weight,
           round({clamp(f'{d(0.64)} * lexical + {d(0.18)} * w + ({_kinds("entity_type", u, _BONUS)}) + ({built})')}, 6) AS initial_score, source, seq, tie, n
    FROM (SELECT *, {lexical} AS lexical, {clamp(f'weight + ({_kinds("entity_type", u, _MOVED)})', 0.0, 1.30)} AS w
          FROM (SELECT *, {norm('candidate_label')} AS cl, {last(u)} AS candidate_uri_token, {norm(last(u))} AS ct FROM ({found})))
    """


_TERM = "entity_id, entity_type, label, normalized_label, expanded, position"


def _spec(uri: str, label: str, weight: float, source: str) -> str:
    return f"{{'u': {uri}, 'l': {label}, 'w': {d(weight)}, 's': '{source}'}}"


def _constructed() -> str:
    v = "variant"
    n = "vn"
    controlled = "CASE variant " + " ".join(f"WHEN {q(k)} THEN [{', '.join(_spec(q(b + x), q(x), w, CONTROLLED_SOURCE) for b, x, w in specs)}]" for k, specs in CONTROLLED_CANDIDATES.items()) + f" ELSE list_filter([{_spec(q(''), q(''), 0.0, '')}], lambda z: false) END"
    specs = (
        f"CASE entity_type WHEN 'class' THEN [{_spec(named(ONTOLOGY, camel0(n)), camel0(n), 1.12, 'dbpedia_ontology_class_construction')}]"
        f" WHEN 'property' THEN list_concat([{_spec(named(ONTOLOGY, f'({lower_camel(n)})'), lower_camel(n), 1.12, 'dbpedia_ontology_property_construction')}, {_spec(named(PROPERTY, f'replace({n}, chr(32), chr(95))'), v, 1.04, 'dbpedia_property_construction')}], {controlled})"
        f" WHEN 'individual' THEN [{_spec(named(RESOURCE, camel0(n)), camel0(n), 1.10, 'dbpedia_resource_construction')}] END"
    )
    rows = f"SELECT *, {specs} AS specs FROM (SELECT *, {norm('variant')} AS vn FROM variants)"
    each = f"SELECT *, specs[j].u AS candidate_uri, specs[j].l AS candidate_label, specs[j].w AS weight, [specs[j].s] AS sources, (variant_at - 1) * 100 + j - 1 AS n FROM ({rows}) x, range(1, 1 + len(x.specs)) AS r(j)"
    first = f"SELECT * FROM ({each}) WHERE candidate_uri <> '' QUALIFY row_number() OVER (PARTITION BY entity_id, candidate_uri ORDER BY n) = 1"
    return _scored(f"SELECT {_TERM}, candidate_uri, candidate_label, ['{CONSTRUCTION}'] AS strategies, sources, variant AS matched, weight, 0 AS source, position AS seq, '' AS tie, n FROM ({first})")


def _from_labels(cap: int) -> str:
    keyed = f"SELECT *, list_distinct([nl, nt]) AS keys FROM (SELECT seq, resource AS candidate_uri, label AS candidate_label, {norm('label')} AS nl, {norm(last('resource'))} AS nt FROM kg_labels WHERE trim(resource) <> '' AND trim(label) <> '')"
    strategies = "list_filter([CASE WHEN nl = normalized_label THEN 'exact_label' END, CASE WHEN list_contains(expanded, nl) THEN 'expanded_label' END, CASE WHEN list_contains(expanded, nt) THEN 'resource_token' END], lambda s: s IS NOT NULL)"
    found = f"SELECT v.*, k.seq, candidate_uri, candidate_label, {strategies} AS strategies FROM (SELECT * , unnest(keys) AS key FROM ({keyed})) k JOIN variants v ON v.variant = k.key"
    capped = f"SELECT *, count(*) OVER (ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM ({found})"
    return _scored(f"SELECT {_TERM}, candidate_uri, candidate_label, strategies, ['dbpedia_labels'] AS sources, variant AS matched, 0.90::DOUBLE AS weight, 1 AS source, seq, variant AS tie, position AS n FROM ({capped}) WHERE earlier < {cap}")


def _from_types(cap: int) -> str:
    base = f"SELECT seq, resource, class, {norm(last('class'))} AS ct, {norm(last('resource'))} AS rt FROM kg_types"
    keyed = f"SELECT *, list_distinct(list_filter(list_concat([ct, array_to_string({stemmed('ct')}, ' ')], {words('ct')}, [rt]), lambda k: k <> '')) AS keys FROM ({base})"
    found = f"SELECT v.*, k.seq, CASE WHEN entity_type = 'class' THEN class ELSE resource END AS candidate_uri FROM (SELECT *, unnest(keys) AS key FROM ({keyed})) k JOIN variants v ON v.variant = k.key WHERE entity_type IN ('class', 'individual')"
    first = f"SELECT * FROM ({found}) QUALIFY row_number() OVER (PARTITION BY entity_id, candidate_uri ORDER BY seq, variant, position) = 1"
    capped = f"SELECT *, count(*) OVER (ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM ({first})"
    pick = lambda a, b: f"CASE WHEN entity_type = 'class' THEN {a} ELSE {b} END"
    return _scored(
        f"SELECT {_TERM}, candidate_uri, {last('candidate_uri')} AS candidate_label, [{pick(q('ontology_class_token'), q('resource_from_instance_types'))}] AS strategies,"
        f" [{pick(q('dbpedia_instance_types_classes'), q('dbpedia_instance_types_resources'))}] AS sources, variant AS matched, {pick(d(0.98), d(0.95))} AS weight, 2 AS source, seq, variant AS tie, position AS n FROM ({capped}) WHERE earlier < {cap}"
    )


def _from_properties(cap: int) -> str:
    score = f"greatest({levenshtein('variant', 'name')}, {token_jaccard('variant', 'name')}, {stem_jaccard('variant', 'name')}, {bigram_jaccard('variant', 'name')}, {prefix('variant', 'name')})"
    pairs = f"SELECT *, {score} AS score FROM (SELECT property, frequency, first, {norm(last('property'))} AS name FROM frequency) f, variants WHERE entity_type = 'property' AND name <> ''"
    best = f"SELECT * FROM ({pairs}) WHERE score >= 0.78 QUALIFY row_number() OVER (PARTITION BY property, entity_id ORDER BY score DESC, variant_at) = 1"
    placed = f"SELECT *, row_number() OVER (ORDER BY frequency DESC, first, position) AS place FROM ({best})"
    return _scored(
        f"SELECT {_TERM}, property AS candidate_uri, {last('property')} AS candidate_label, ['property_frequency', 'property_token'] AS strategies, ['dbpedia_properties', 'dbpedia_property_frequency'] AS sources,"
        f" variant AS matched, 0.82::DOUBLE + least(ln(frequency + 1.0::DOUBLE) / 20.0::DOUBLE, 0.20::DOUBLE) AS weight, 3 AS source, place AS seq, '' AS tie, position AS n FROM ({placed}) WHERE place <= {cap}"
    )


_SOURCES = {"constructed": (lambda cap: _constructed(), "variants"), "labels": (_from_labels, "variants kg_labels"), "types": (_from_types, "variants kg_types"), "properties": (_from_properties, "variants frequency")}
for _name, (_make, _needs) in _SOURCES.items():
    CTE[f"c_{_name}"] = (_make(SOURCE_CAP), _needs)
    CTE[f"small_{_name}"] = (_make(SMALL_CAP), _needs)

_FIRST = "reference_entity_type, reference_label, reference_normalized_label, reference_expanded_terms, candidate_label, candidate_uri_token, candidate_namespace"
CTE["c_all"] = (" UNION ALL ".join(f"SELECT * FROM c_{n}" for n in _SOURCES), " ".join(f"c_{n}" for n in _SOURCES))
CTE["merged"] = (
    "SELECT *, round(least(best + least(strategy_count * 0.04::DOUBLE, 0.20::DOUBLE) + least(evidence_source_count * 0.04::DOUBLE, 0.20::DOUBLE), 1.0::DOUBLE), 6) AS initial_score FROM ("
    "SELECT reference_entity_id, candidate_uri, "
    + ", ".join(f"arg_min({c}, (source, seq, tie, n)) AS {c}" for c in _FIRST.split(", "))
    + ", list_sort(list_distinct(flatten(list(strategies)))) AS strategies, list_sort(list_distinct(flatten(list(evidence_sources)))) AS evidence_sources, list_sort(list_distinct(flatten(list(matched_terms)))) AS matched_terms,"
    " len(list_distinct(flatten(list(strategies))))::INTEGER AS strategy_count, len(list_distinct(flatten(list(evidence_sources))))::INTEGER AS evidence_source_count,"
    " round(avg(average_evidence_weight), 6) AS average_evidence_weight, max(initial_score) AS best, min((source, seq, tie, n)) AS place FROM c_all GROUP BY reference_entity_id, candidate_uri)",
    "c_all",
)
CTE["top"] = (
    f"SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY reference_entity_id ORDER BY initial_score DESC, evidence_source_count DESC, strategy_count DESC, place) <= {TOP_K}",
    "merged",
)
_LISTS = "array_to_string(strategies, '|') AS strategies, array_to_string(evidence_sources, '|') AS evidence_sources, array_to_string(matched_terms, '|') AS matched_terms"
_ONE = f"reference_entity_id, candidate_uri, {_FIRST}, {_LISTS}, average_evidence_weight, initial_score"
_CANDIDATE = f"{_ONE}, strategy_count, evidence_source_count"

# ---- features, scores, evaluation -------------------------------------------------------------------------------

CTE["property_facts"] = (
    "SELECT uri, sum(literal)::INTEGER AS literal_property_count, sum(object)::INTEGER AS object_property_count, sum(infobox)::INTEGER AS infobox_property_count, count(*)::INTEGER AS total_property_count, avg(coalesce(frequency, 0))::DOUBLE AS mean FROM ("
    "SELECT resource AS uri, property, max((kind = 'literal')::INTEGER) AS literal, max((kind = 'object')::INTEGER) AS object, max((kind = 'infobox')::INTEGER) AS infobox FROM tagged GROUP BY resource, property) LEFT JOIN frequency USING (property) GROUP BY uri",
    "tagged frequency",
)


def _property_statistics(mean: str) -> str:
    return (
        f"round({safe_log('total_property_count')}, 6) AS log_total_property_count, round({mean}, 6) AS average_property_frequency, round({safe_log(mean)}, 6) AS log_average_property_frequency,"
        f" round(CASE WHEN {mean} > 0 THEN {clamp(f'1.0::DOUBLE / ln({mean} + 2.0::DOUBLE)')} ELSE 0.0::DOUBLE END, 6) AS discriminative_property_score"
    )


_LEXICAL: dict[str, str] = {}
for _p, _o in (("", "nl"), ("uri_", "nt")):
    _LEXICAL[f"{_p}levenshtein_similarity" if _p else "levenshtein_label_similarity"] = r6(levenshtein("nr", _o))
    _LEXICAL[f"{_p}token_jaccard_similarity"] = r6(token_jaccard("nr", _o))
    _LEXICAL[f"{_p}stemmed_jaccard_similarity"] = r6(stem_jaccard("nr", _o))
    _LEXICAL[f"{_p}char_bigram_jaccard_similarity"] = r6(bigram_jaccard("nr", _o))
    _LEXICAL[f"{_p}prefix_similarity"] = r6(prefix("nr", _o))
_LEXICAL["containment_similarity"] = r6(f"greatest({containment('nr', 'nl')}, {containment('nr', 'nt')})")
_LEXICAL["exact_label_match"] = "(nr = nl)::INTEGER"
_LEXICAL["exact_uri_token_match"] = "(nr = nt)::INTEGER"

CTE["features"] = (
    "SELECT x.*, " + ", ".join(f"{e} AS {n}" for n, e in _LEXICAL.items()) + ", "
    f"{feature('candidate_uri')} AS candidate_namespace_feature, {is_class('candidate_uri')}::INTEGER AS is_dbpedia_ontology_class, {is_res('candidate_uri')}::INTEGER AS is_dbpedia_resource, {is_prop('candidate_uri')}::INTEGER AS is_dbpedia_property,"
    f" (dbpedia_type_count > 0)::INTEGER AS has_dbpedia_type, {_property_statistics('mean')}, round({safe_log('class_instance_count')}, 6) AS class_instance_log_score, initial_score AS initial_score_numeric"
    f" FROM (SELECT top.*, {norm('reference_label')} AS nr, {norm('candidate_label')} AS nl, {norm('candidate_uri_token')} AS nt, coalesce(t.n, 0)::INTEGER AS dbpedia_type_count, coalesce(c.n, 0)::INTEGER AS class_instance_count,"
    " coalesce(literal_property_count, 0) AS literal_property_count, coalesce(object_property_count, 0) AS object_property_count, coalesce(infobox_property_count, 0) AS infobox_property_count, coalesce(total_property_count, 0) AS total_property_count, coalesce(mean, 0.0::DOUBLE) AS mean"
    " FROM top LEFT JOIN property_facts p ON p.uri = candidate_uri LEFT JOIN (SELECT resource, count(DISTINCT class) AS n FROM kg_types GROUP BY resource) t ON t.resource = candidate_uri LEFT JOIN (SELECT class, count(*) AS n FROM kg_types GROUP BY class) c ON c.class = candidate_uri) x",
    "top property_facts kg_types",
)
_FEATURES = ", ".join([
    *_LEXICAL, "candidate_namespace_feature", "is_dbpedia_ontology_class", "is_dbpedia_resource", "is_dbpedia_property", "has_dbpedia_type", "dbpedia_type_count",
    "literal_property_count", "object_property_count", "infobox_property_count", "total_property_count", "log_total_property_count", "average_property_frequency",
    "log_average_property_frequency", "discriminative_property_score", "class_instance_count", "class_instance_log_score", "initial_score_numeric",
])


def _any(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in parts) + ")"


_T, _U = "reference_entity_type", "candidate_uri"
CTE["flagged"] = (
    f"SELECT *, (strategy_text LIKE '%{CONSTRUCTION}%' AND NOT real AND NOT controlled AND NOT (total_property_count > 0 OR average_property_frequency > 0 OR class_instance_count > 0) AND {_any('source_text', CONSTRUCTION_SOURCES)}) AS weak,"
    f" CASE WHEN {_T} = 'class' AND {is_class(_U)} THEN 1.0::DOUBLE WHEN {_T} = 'class' AND {is_res(_U)} THEN 0.35::DOUBLE WHEN {_T} = 'property' AND {is_oprop(_U)} THEN 1.0::DOUBLE WHEN {_T} = 'property' AND {is_rprop(_U)} THEN 0.90::DOUBLE"
    f" WHEN {_T} = 'property' AND {is_res(_U)} THEN 0.15::DOUBLE WHEN {_T} = 'individual' AND {is_res(_U)} THEN 1.0::DOUBLE WHEN {_T} = 'individual' AND {is_class(_U)} THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS policy,"
    f" {clamp(f'{d(0.60)} * has_dbpedia_type + {d(0.40)} * ({log_share("dbpedia_type_count", 5.0)})')} AS typed, {log_share('total_property_count', 8.0)} AS owned, {log_share('class_instance_count', 12.0)} AS members"
    f" FROM (SELECT *, {_any('source_text', REAL_SOURCES)} AS real, (contains(source_text, '{CONTROLLED_SOURCE}') OR ({norm(last(_U))} IN ({names(CONTROLLED_TOKENS)}) AND {_any('matched_text', CONTROLLED_TOKENS)})) AS controlled"
    f" FROM (SELECT *, array_to_string(strategies, '|') AS strategy_text, array_to_string(evidence_sources, '|') AS source_text, {norm("array_to_string(matched_terms, '|')")} AS matched_text FROM features))",
    "features",
)


def _sum(*parts: tuple[float, str]) -> str:
    return " + ".join(f"{d(w)} * {c}" for w, c in parts)


def _raised(e: str, when: str, by: float) -> str:
    return f"CASE WHEN {when} THEN least(({e}) + {d(by)}, 1.0::DOUBLE) ELSE ({e}) END"


def _finished(e: str, factor: float) -> str:
    return f"round({clamp(f'CASE WHEN weak THEN ({e}) * {d(factor)} ELSE ({e}) END')}, 6)"


_LABEL = _sum((0.24, "levenshtein_label_similarity"), (0.18, "token_jaccard_similarity"), (0.14, "stemmed_jaccard_similarity"), (0.14, "char_bigram_jaccard_similarity"), (0.10, "prefix_similarity"), (0.12, "containment_similarity"), (0.08, "exact_label_match"))
_TOKEN = _sum((0.28, "uri_levenshtein_similarity"), (0.20, "uri_token_jaccard_similarity"), (0.14, "uri_stemmed_jaccard_similarity"), (0.14, "uri_char_bigram_jaccard_similarity"), (0.10, "uri_prefix_similarity"), (0.14, "exact_uri_token_match"))
CTE["parts"] = (
    f"SELECT *, {d(0.72)} * ({_LABEL}) + {d(0.28)} * ({_TOKEN}) AS lex0,"
    f" CASE {_T} WHEN 'class' THEN {_sum((0.62, 'policy'), (0.13, 'typed'), (0.10, 'owned'), (0.15, 'members'))} WHEN 'property' THEN {_sum((0.70, 'policy'), (0.20, 'owned'), (0.10, 'typed'))} WHEN 'individual' THEN {_sum((0.62, 'policy'), (0.23, 'typed'), (0.15, 'owned'))} ELSE {_sum((0.50, 'policy'), (0.20, 'typed'), (0.15, 'owned'), (0.15, 'members'))} END AS str0,"
    f" {d(0.55)} * {clamp('discriminative_property_score')} + {d(0.25)} * {clamp('CASE WHEN average_property_frequency <= 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / ln(average_property_frequency + 2.0::DOUBLE) END')} + {d(0.20)} * owned AS sta0,"
    f" {d(0.28)} * {clamp('strategy_count / 5.0::DOUBLE')} + {d(0.32)} * {clamp('evidence_source_count / 5.0::DOUBLE')} + {d(0.20)} * {clamp('average_evidence_weight')} + {d(0.20)} * {clamp('initial_score_numeric')} AS mul0 FROM flagged",
    "flagged",
)
CTE["components"] = (
    f"SELECT *, {_finished(_raised('lex0', '(exact_label_match = 1 OR exact_uri_token_match = 1)', 0.06), 0.82)} AS lexical_score, {_finished(_raised('str0', 'controlled', 0.12), 0.78)} AS structural_score,"
    f" {_finished(_raised('sta0', 'controlled', 0.08), 0.70)} AS statistical_score, {_finished(_raised('mul1', 'controlled', 0.10), 0.68)} AS multisource_score, round(policy, 6) AS type_policy_score,"
    " real::INTEGER AS has_real_dbpedia_evidence, controlled::INTEGER AS has_controlled_direct_evidence, weak::INTEGER AS is_weak_constructed_candidate"
    f" FROM (SELECT *, {_raised('mul0', 'real', 0.08)} AS mul1 FROM parts)",
    "parts",
)
_COMPONENTS = ("lexical_score", "structural_score", "statistical_score", "multisource_score", "type_policy_score")
_FLAGS = "has_real_dbpedia_evidence, has_controlled_direct_evidence, is_weak_constructed_candidate"
_STEPS = [(f"{_T} = 'class' AND {is_class(_U)}", 0.08), (f"{_T} = 'class' AND {is_res(_U)}", -0.05), (f"{_T} = 'property' AND {is_prop(_U)}", 0.08), (f"{_T} = 'individual' AND {is_res(_U)}", 0.08), ("controlled", 0.08), ("weak", -0.15)]


def _adjusted(e: str) -> str:
    return f"({e})" + "".join(f" + CASE WHEN {when} THEN {d(by)} ELSE 0.0::DOUBLE END" for when, by in _STEPS)


def _order(score: str) -> str:
    return f"{score} DESC, type_policy_score DESC, structural_score DESC, lexical_score DESC, has_controlled_direct_evidence DESC, has_real_dbpedia_evidence DESC, is_weak_constructed_candidate, place"


_BLEND = " + ".join(f"{d(w)} * {c}" for w, c in zip(FINAL_WEIGHTS, _COMPONENTS, strict=True))
CTE["scored"] = (f"SELECT *, round({clamp(_adjusted(_BLEND))}, 6) AS final_alignment_score FROM components", "components")
CTE["ranked"] = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reference_entity_id ORDER BY {_order('final_alignment_score')})::INTEGER AS rank FROM scored) WHERE rank <= {TOP_K}", "scored")

CTE["models"] = (" UNION ALL ".join(f"SELECT '{m}' AS ablation_model, " + ", ".join(f"{d(w)} AS w{i}" for i, w in enumerate(ws)) + f", {p} AS post" for m, (ws, p) in ABLATION_MODELS.items()), "")
_MODEL = " + ".join(f"w{i} * {c}" for i, c in enumerate(_COMPONENTS))
CTE["model_scores"] = (f"SELECT *, round({clamp(f'CASE WHEN post THEN {_adjusted(_MODEL)} ELSE {_MODEL} END')}, 6) AS ablation_score FROM components, models", "components models")
CTE["model_ranks"] = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ablation_model, reference_entity_id ORDER BY {_order('ablation_score')})::INTEGER AS rank FROM model_scores) WHERE rank <= {TOP_K}", "model_scores")

_GOLD_FIXED = [("name", PROPERTY), ("brand", PROPERTY), ("size", PROPERTY), ("nation", ONTOLOGY), ("region", ONTOLOGY), ("part", ONTOLOGY), ("purchase", PROPERTY), ("colour", PROPERTY)]
CTE["gold"] = (
    "SELECT reference_entity_id, list_sort(list(DISTINCT uri)) AS expected FROM ("
    f"SELECT 'ref:class:' || p_type AS reference_entity_id, {_class('p_type')} AS uri FROM part UNION ALL SELECT 'ref:concept:' || c_mktsegment, {_class('c_mktsegment')} FROM customer"
    f" UNION ALL SELECT 'ref:individual:' || r_name, '{RESOURCE}Region_' || r_regionkey::VARCHAR FROM region UNION ALL SELECT 'ref:instance:' || n_name, '{RESOURCE}Nation_' || n_nationkey::VARCHAR FROM nation"
    f" UNION ALL SELECT 'ref:individual:' || p_name, '{RESOURCE}Part_' || p_partkey::VARCHAR FROM part UNION ALL "
    + " UNION ALL ".join(f"SELECT {q('ref:objectproperty:' + p)}, {q(b + p)}" for p, b in _GOLD_FIXED)
    + ") WHERE reference_entity_id IS NOT NULL AND uri IS NOT NULL GROUP BY reference_entity_id",
    "",
)


def _details(ranks: str, score: str, by: str = "") -> str:
    asked = f"(SELECT gold.*, m.{by} FROM gold, (SELECT DISTINCT {by} FROM {ranks}) m)" if by else "gold"
    on = f"r.reference_entity_id = g.reference_entity_id" + (f" AND r.{by} = g.{by}" if by else "")
    keys = ", ".join(x for x in (f"g.{by}" if by else "", "g.reference_entity_id") if x)
    hits = ", ".join(f"coalesce((min(CASE WHEN list_contains(g.expected, r.candidate_uri) THEN r.rank END) <= {k})::INTEGER, 0) AS hit_at_{k}" for k in HIT_RANKS)
    first = "min(CASE WHEN list_contains(g.expected, r.candidate_uri) THEN r.rank END)"
    top = lambda c: f"coalesce(max(CASE WHEN r.rank = 1 THEN r.{c} END), '')"
    return (
        f"SELECT '{EXPERIMENT}' AS experiment_name, {keys}, array_to_string(any_value(g.expected), '|') AS expected_candidate_uris, count(r.rank)::BIGINT AS num_candidates, coalesce({first}, 0)::INTEGER AS first_hit_rank, coalesce(1.0::DOUBLE / {first}, 0.0::DOUBLE) AS rr, round(coalesce(1.0::DOUBLE / {first}, 0.0::DOUBLE), 6) AS reciprocal_rank, {hits},"
        f" {top('candidate_uri')} AS top1_candidate_uri, {top('candidate_label')} AS top1_candidate_label, coalesce(max(CASE WHEN r.rank = 1 THEN r.{score} END), 0.0::DOUBLE) AS top1_score, coalesce(max(CASE WHEN r.rank = 1 THEN r.rank END)::VARCHAR, '') AS top1_rank"
        f" FROM {asked} g LEFT JOIN {ranks} r ON {on} GROUP BY {keys}"
    )


CTE["details"] = (_details("ranked", "final_alignment_score"), "ranked gold")
CTE["model_details"] = (_details("model_ranks", "ablation_score", "ablation_model"), "model_ranks gold")


def _metrics(rows: str, by: str = "") -> str:
    keys = "experiment_name" + (f", {by}" if by else "")
    values = [*[(f"Precision@{k}", f"round(sum(hit_at_{k})::DOUBLE / count(*), 6)") for k in HIT_RANKS], ("MRR", "round(sum(rr) / count(*), 6)"), ("Coverage", "round((count(*) - sum((num_candidates = 0)::INTEGER))::DOUBLE / count(*), 6)"), ("Evaluated references", "count(*)::DOUBLE"), ("Missing predictions", "sum((num_candidates = 0)::INTEGER)::DOUBLE")]
    return " UNION ALL ".join(f"SELECT {keys}, {q(n)} AS metric, {e} AS value FROM {rows} GROUP BY {keys}" for n, e in values)


# ---- the queries ------------------------------------------------------------------------------------------------

_PAIRS = " UNION ALL ".join(f"SELECT '{s}' || l.{k}::BIGINT::VARCHAR AS id, {norm(f'l.{c}')} AS a, {norm(f'r.{c}')} AS b FROM {t} l JOIN {t} r ON r.{k} = l.{k} + 1" for t, k, c, s in [("part", "p_partkey", "p_name", "p"), ("nation", "n_nationkey", "n_name", "n"), ("region", "r_regionkey", "r_name", "r"), ("benchmark", "item_id", "text", "b")])
CTE["pairs"] = (_PAIRS, "")
CTE["uris"] = ("SELECT DISTINCT uri FROM (SELECT resource AS uri FROM kg_labels UNION ALL SELECT class FROM kg_types UNION ALL SELECT property FROM tagged UNION ALL SELECT url FROM pages)", "kg_labels kg_types tagged")


def _line(*parts: str) -> str:
    return " || ' ' || ".join(parts) + " || ' .'"


def _angle(c: str) -> str:
    return f"'<' || {c} || '>'"


def _quote(c: str) -> str:
    return "'\"' || replace(" + c + ", '\"', '\\\"') || '\"'"


CTE["lines"] = (
    f"SELECT seq, {_line(_angle('resource'), q('<http://www.w3.org/2000/01/rdf-schema#label>'), _quote('label') + ' || ' + q('@en'))} AS value FROM kg_labels"
    f" UNION ALL SELECT seq, {_line(_angle('resource'), q('<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>'), _angle('class'))} FROM kg_types"
    f" UNION ALL SELECT seq, {_line(_angle('resource'), _angle('property'), _quote('v') + ' || ' + q('^^<http://www.w3.org/2001/XMLSchema#string>'))} FROM literal_facts"
    f" UNION ALL SELECT seq, {_line(_angle('resource'), _angle('property'), _angle('v'))} FROM object_facts"
    f" UNION ALL SELECT seq, {_line(_angle('resource'), _angle('property'), _quote('v'))} FROM infobox_facts"
    f" UNION ALL SELECT seq, {_line(_angle('resource'), q('<http://www.w3.org/2002/07/owl#sameAs>'), _angle(q('http://example.org/same/') + ' || md5(resource)'))} FROM kg_labels",
    "kg_labels kg_types literal_facts object_facts infobox_facts",
)
_CLEAN = r"regexp_replace(replace(replace(replace(replace(regexp_extract({0}, '\"((?:[^\"\\]|\\.)*)\"', 1), '\\\"', '\"'), '\n', ' '), '\t', ' '), '\r', ' '), '^\s+|\s+$', '', 'g')".replace('\\"', '"')
CTE["parsed"] = (f"SELECT seq, regexp_extract_all(value, '<([^>]*)>', 1) AS u, {_CLEAN.format('value')} AS lit FROM lines", "lines")

ORACLES = {
    "normalize_text": sql(f"SELECT doc_id, md5(n) AS normalized_md5, length(n)::INTEGER AS n FROM (SELECT doc_id, {norm('text')} AS n FROM documents)", ""),
    "normalize_text_index": sql(f"SELECT doc_id, md5(n) AS normalized_md5, length(n)::INTEGER AS n FROM (SELECT doc_id, {norm_index('text')} AS n FROM documents)", ""),
    "split_tokens": sql(f"SELECT conv_id, turn, len(w)::BIGINT AS n_tokens, array_to_string(w, '|') AS tokens FROM (SELECT conv_id, turn, {words(norm('text'))} AS w FROM conversations)", ""),
    "simple_stem": sql(f"SELECT token, {stem('token')} AS stem FROM (SELECT DISTINCT unnest({words(norm('text'))}) AS token FROM benchmark)", ""),
    "normalize_type": sql(f"SELECT entity_type, count(*)::BIGINT AS n, {type_name('entity_type')} AS normalized FROM (SELECT entity_type FROM raw_terms UNION ALL SELECT p_type FROM part UNION ALL SELECT event_type FROM events) GROUP BY entity_type", "raw_terms"),
    "uri_last_token": f"SELECT page_id, {last('url')} AS token FROM pages",
    "uri_namespace": sql(f"SELECT uri, {namespace('uri')} AS namespace FROM uris", "uris"),
    "uri_kinds": sql(f"SELECT uri, {is_class('uri')}::INTEGER AS is_class, {is_oprop('uri')}::INTEGER AS is_ontology_property, {is_rprop('uri')}::INTEGER AS is_raw_property, {is_prop('uri')}::INTEGER AS is_property, {is_res('uri')}::INTEGER AS is_resource, {feature('uri')} AS feature FROM uris", "uris"),
    "camel_case_uris": sql(
        f"SELECT entity_id, {camel0('n')} AS camel, {lower_camel('n')} AS lower_camel, {named(ONTOLOGY, camel0('n'))} AS class_uri, {named(ONTOLOGY, f'({lower_camel("n")})')} AS property_uri, {named(PROPERTY, 'replace(n, chr(32), chr(95))')} AS raw_property_uri, {named(RESOURCE, camel0('n'))} AS resource_uri FROM (SELECT entity_id, {norm('label')} AS n FROM raw_terms)",
        "raw_terms",
    ),
    "term_expansion": sql("SELECT entity_id, entity_type, normalized_label, array_to_string(expanded, '|') AS expanded_terms FROM terms", "terms"),
    "levenshtein_sim": sql(f"SELECT id, {r6(levenshtein('a', 'b'))} AS levenshtein_sim FROM pairs", "pairs"),
    "token_jaccard": sql(f"SELECT id, {r6(token_jaccard('a', 'b'))} AS token_jaccard FROM pairs", "pairs"),
    "stem_jaccard": sql(f"SELECT id, {r6(stem_jaccard('a', 'b'))} AS stem_jaccard FROM pairs", "pairs"),
    "bigram_jaccard": sql(f"SELECT id, {r6(bigram_jaccard('a', 'b'))} AS bigram_jaccard FROM pairs", "pairs"),
    "prefix_sim": sql(f"SELECT id, {r6(prefix('a', 'b'))} AS prefix_sim FROM pairs", "pairs"),
    "containment_sim": sql(f"SELECT id, {r6(containment('a', 'b'))} AS containment_sim FROM pairs", "pairs"),
    "numeric_functions": f"SELECT event_id, coalesce(try_cast(props AS DOUBLE), 0.0::DOUBLE) AS as_float, coalesce(trunc(value)::INTEGER, 0) AS as_int, {clamp('value / 100.0::DOUBLE')} AS clamped, {r6(safe_log('value'))} AS safe_log, {r6(log_share('value', 10.0))} AS log_share, {r6('least(ln(abs(value) + 1.0::DOUBLE) / 20.0::DOUBLE, 0.20::DOUBLE)')} AS bonus FROM events",
    "extract_uris": "SELECT page_id, len(u)::BIGINT AS n, md5(array_to_string(u, chr(10))) AS uris_md5 FROM (SELECT page_id, regexp_extract_all(html, '<([^>]*)>', 1) AS u FROM pages)",
    "extract_literal": f"SELECT page_id, md5({_CLEAN.format('html')}) AS literal_md5 FROM pages",
    "parse_labels": sql("SELECT seq, u[1] AS resource, lit AS label FROM parsed WHERE len(u) >= 1 AND lit <> ''", "parsed"),
    "parse_instance_types": sql("SELECT seq, u[1] AS resource, u[3] AS class FROM parsed WHERE len(u) >= 3", "parsed"),
    "parse_types_by_predicate": sql("SELECT seq, u[1] AS resource, u[2] AS class FROM parsed WHERE len(u) >= 2", "parsed"),
    "parse_literal_properties": sql("SELECT seq, u[1] AS resource, u[2] AS property, lit AS value FROM parsed WHERE len(u) >= 2 AND lit <> ''", "parsed"),
    "parse_object_properties": sql("SELECT seq, u[1] AS resource, u[2] AS property, u[3] AS object FROM parsed WHERE len(u) >= 3", "parsed"),
    "parse_infobox_properties": sql("SELECT seq, u[1] AS resource, u[2] AS property, lit AS value FROM parsed WHERE len(u) >= 2 AND lit <> ''", "parsed"),
    "parse_sameas_links": sql("SELECT seq, u[1] AS resource, u[3] AS same_as FROM parsed WHERE len(u) >= 3", "parsed"),
    "label_index": sql(f"SELECT resource, arg_max(label, seq) AS label FROM kg_labels WHERE {norm_index('label')} <> '' GROUP BY resource", "kg_labels"),
    "normalized_label_index": sql(f"SELECT key, string_agg(resource, '|' ORDER BY seq, resource) AS resources FROM (SELECT *, {norm_index('label')} AS key FROM kg_labels) WHERE key <> '' GROUP BY key", "kg_labels"),
    "token_index": sql(f"SELECT key, string_agg(resource, '|' ORDER BY seq, resource) AS resources FROM (SELECT *, {norm_index(last('resource'))} AS key FROM kg_labels) WHERE key <> '' GROUP BY key", "kg_labels"),
    "type_index": sql("SELECT resource, string_agg(DISTINCT class, '|' ORDER BY class) AS classes FROM kg_types GROUP BY resource", "kg_types"),
    "class_instances": sql("SELECT class, count(DISTINCT resource)::BIGINT AS n, md5(string_agg(DISTINCT resource, '|' ORDER BY resource)) AS resources_md5 FROM kg_types GROUP BY class", "kg_types"),
    "entity_property_index": sql("SELECT resource, " + ", ".join(f"coalesce(string_agg(DISTINCT CASE WHEN kind = '{k}' THEN property END, '|' ORDER BY CASE WHEN kind = '{k}' THEN property END), '') AS {k}_properties" for k in ("literal", "object", "infobox")) + " FROM tagged GROUP BY resource", "tagged"),
    "property_frequency": sql("SELECT property, frequency FROM frequency", "frequency"),
    "candidates_constructed": sql(f"SELECT {_ONE} FROM c_constructed", "c_constructed"),
    "candidates_labels": sql(f"SELECT {_ONE} FROM c_labels", "c_labels"),
    "candidates_types": sql(f"SELECT {_ONE} FROM c_types", "c_types"),
    "candidates_property_theta": sql(f"SELECT {_ONE} FROM c_properties", "c_properties"),
    "candidates_capped": sql(" UNION ALL ".join(f"SELECT '{n}' AS origin, reference_entity_id, candidate_uri, array_to_string(matched_terms, '|') AS matched_terms FROM small_{n}" for n in _SOURCES), " ".join(f"small_{n}" for n in _SOURCES)),
    "merge_candidates": sql(f"SELECT {_CANDIDATE} FROM merged", "merged"),
    "topk_per_reference": sql(f"SELECT {_CANDIDATE} FROM top", "top"),
    "candidates_per_reference": sql("SELECT reference_entity_id, count(*)::BIGINT AS rows FROM top GROUP BY reference_entity_id", "top"),
    "type_evidence": sql("SELECT resource AS uri, count(DISTINCT class)::BIGINT AS dbpedia_type_count FROM kg_types WHERE resource IN (SELECT resource FROM kg_labels) GROUP BY resource", "kg_types kg_labels"),
    "semi_join_evidence": sql("SELECT class AS uri, count(*)::BIGINT AS class_instance_count FROM kg_types WHERE class IN (SELECT candidate_uri FROM top) GROUP BY class", "kg_types top"),
    "property_statistics": sql(f"SELECT uri, literal_property_count, object_property_count, infobox_property_count, total_property_count, {_property_statistics('mean')} FROM property_facts WHERE uri IN (SELECT resource FROM kg_labels)", "property_facts kg_labels"),
    "candidate_features": sql(f"SELECT {_CANDIDATE}, {_FEATURES} FROM features", "features"),
    "component_scores": sql(f"SELECT reference_entity_id, candidate_uri, {', '.join(_COMPONENTS)}, {_FLAGS} FROM components", "components"),
    "final_rank": sql("SELECT reference_entity_id, rank, candidate_uri, candidate_label, final_alignment_score FROM ranked", "ranked"),
    "best_alignments": sql(f"SELECT {_CANDIDATE}, {_FEATURES}, {', '.join(_COMPONENTS)}, final_alignment_score, {_FLAGS}, rank FROM ranked WHERE rank = 1", "ranked"),
    "evaluation_details": sql("SELECT * EXCLUDE (rr) FROM details", "details"),
    "evaluation_metrics": sql(_metrics("details"), "details"),
    "ablation_rankings": sql("SELECT ablation_model, reference_entity_id, rank AS ablation_rank, candidate_uri, ablation_score FROM model_ranks", "model_ranks"),
    "ablation_metrics": sql(_metrics("model_details", "ablation_model"), "model_details"),
    "gold_standard": sql("SELECT reference_entity_id, array_to_string(expected, '|') AS expected FROM gold", "gold"),
    "merged_property_sets": sql("SELECT resource AS uri, string_agg(DISTINCT property, '|' ORDER BY property) AS properties FROM tagged GROUP BY resource", "tagged"),
}
