"""Settings of the alignment engine: name spaces, limits, weights, word lists, and the paths of an experiment."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

# ---- fixed values: they must be these for the same results ----

ONTOLOGY = "http://dbpedia.org/ontology/"
PROPERTY = "http://dbpedia.org/property/"
RESOURCE = "http://dbpedia.org/resource/"

TOP_K = 30
SOURCE_CAP = 10_000
MAX_VARIANTS = 50
HIT_RANKS = (1, 5, 10)
PROPERTY_THRESHOLD = 0.78

STEM_SUFFIXES = (
    "ization", "ational", "fulness", "ousness", "iveness", "tional", "biliti", "lessli", "entli", "ation", "alism", "aliti",
    "ousli", "iviti", "fulli", "enci", "anci", "abli", "izer", "ator", "icate", "ative", "alize", "iciti", "ical", "ness",
    "ments", "ment", "ingly", "edly", "ing", "ed", "ies", "es", "s",
)

PROPERTY_PREFIXES = (
    "has ", "is ", "was ", "were ", "contains ", "contain ", "uses ", "use ", "made of ", "part of ", "produced by ",
    "manufactured by ", "created by ",
)

STOP_WORDS = ("a", "an", "the", "of", "in", "on", "for", "to", "by", "with", "has", "is", "was", "were", "and", "or")

SYNONYMS = {
    "maker": ("maker", "manufacturer", "producer", "creator", "made by", "produced by", "manufactured by"),
    "has maker": ("maker", "manufacturer", "producer", "creator"),
    "manufacturer": ("maker", "manufacturer", "producer", "creator"),
    "producer": ("maker", "manufacturer", "producer", "creator"),
    "creator": ("maker", "manufacturer", "producer", "creator", "author"),
    "author": ("author", "writer", "creator"),
    "region": ("region", "area", "location", "place"),
    "country": ("country", "nation", "state"),
    "food": ("food", "dish", "cuisine", "ingredient"),
    "wine": ("wine", "wine region", "alcoholic beverage", "beverage"),
    "camera": ("camera", "photographic camera", "device"),
}

#: term -> (name space, local name, weight); the local name is also the label.
CONTROLLED_CANDIDATES = {
    "maker": (
        (ONTOLOGY, "manufacturer", 1.15), (ONTOLOGY, "producer", 1.10), (ONTOLOGY, "creator", 1.05),
        (PROPERTY, "maker", 1.05), (PROPERTY, "manufacturer", 1.00), (PROPERTY, "producer", 1.00),
    ),
    "has maker": ((ONTOLOGY, "manufacturer", 1.15), (ONTOLOGY, "producer", 1.10), (PROPERTY, "maker", 1.05)),
    "manufacturer": ((ONTOLOGY, "manufacturer", 1.15), (PROPERTY, "manufacturer", 1.00)),
    "producer": ((ONTOLOGY, "producer", 1.10), (PROPERTY, "producer", 1.00)),
    "region": ((ONTOLOGY, "region", 1.10), (PROPERTY, "region", 1.05)),
    "country": ((ONTOLOGY, "country", 1.10), (PROPERTY, "country", 1.05)),
}
CONTROLLED_TOKENS = ("maker", "manufacturer", "producer", "creator")

TYPE_NAMES = {
    "class": ("class", "concept"),
    "property": ("property", "objectproperty", "dataproperty", "object property", "data property", "annotation property"),
    "individual": ("individual", "instance", "resource"),
}

REAL_SOURCES = (
    "dbpedia_labels", "dbpedia_instance_types_classes", "dbpedia_instance_types_resources", "dbpedia_properties",
    "dbpedia_property_frequency",
)
CONSTRUCTION_SOURCES = (
    "dbpedia_ontology_class_construction", "dbpedia_ontology_property_construction", "dbpedia_property_construction",
    "dbpedia_resource_construction",
)
CONTROLLED_SOURCE = "controlled_direct_property_candidate"
CONSTRUCTION = "dbpedia_uri_construction"

COMPONENTS = ("lexical_score", "structural_score", "statistical_score", "multisource_score", "type_policy_score")
FINAL_WEIGHTS = (0.15, 0.55, 0.05, 0.10, 0.15)

#: model -> weights in the order of COMPONENTS, and whether the type policy's adjustments follow.
ABLATION_MODELS = {
    "lexical_only": ((1.0, 0.0, 0.0, 0.0, 0.0), False),
    "structural_only": ((0.0, 1.0, 0.0, 0.0, 0.0), False),
    "statistical_only": ((0.0, 0.0, 1.0, 0.0, 0.0), False),
    "multisource_only": ((0.0, 0.0, 0.0, 1.0, 0.0), False),
    "type_policy_only": ((0.0, 0.0, 0.0, 0.0, 1.0), True),
    "lexical_structural": ((0.58, 0.42, 0.0, 0.0, 0.0), False),
    "lexical_type_policy": ((0.75, 0.0, 0.0, 0.0, 0.25), True),
    "structural_type_policy": ((0.0, 0.75, 0.0, 0.0, 0.25), True),
    "lexical_structural_type_policy": ((0.50, 0.35, 0.0, 0.0, 0.15), True),
    "lexical_structural_statistical": ((0.48, 0.36, 0.16, 0.0, 0.0), False),
    "full_model": ((0.42, 0.34, 0.09, 0.10, 0.05), True),
    "type_aware_full_model": ((0.15, 0.55, 0.05, 0.10, 0.15), True),
}

PILOT_TERMS = (
    ("ref:Wine", "class", "Wine"), ("ref:Food", "class", "Food"), ("ref:Camera", "class", "Camera"),
    ("ref:Chardonnay", "individual", "Chardonnay"), ("ref:Region", "property", "region"),
    ("ref:Country", "property", "country"), ("ref:hasMaker", "property", "hasMaker"),
)

DUMP_BASE = "https://downloads.dbpedia.org/repo/dbpedia"
DUMP_VERSION, DUMP_LANGUAGE = "2020.10.01", "en"
#: dump -> its group and artifact in the catalogue, and what follows the language in the file's name.
DUMPS = {
    "labels": ("generic/labels", ""),
    "instance_types": ("mappings/instance-types", "_specific"),
    "mappingbased_literals": ("mappings/mappingbased-literals", ""),
    "mappingbased_objects": ("mappings/mappingbased-objects", ""),
    "infobox_properties": ("generic/infobox-properties", ""),
    "infobox_property_definitions": ("generic/infobox-property-definitions", ""),
    "commons_sameas_links": ("generic/commons-sameas-links", ""),
}

# ---- end of fixed values ----

EXPERIMENTS = ("pilot", "expanded")


def dump_url(name: str) -> str:
    group, suffix = DUMPS[name]
    artifact = group.rpartition("/")[2]
    return f"{DUMP_BASE}/{group}/{DUMP_VERSION}/{artifact}_lang={DUMP_LANGUAGE}{suffix}.ttl.bz2"


@dataclass(frozen=True)
class Experiment:
    """Where an experiment's inputs and results lie; any file system Spark reads."""

    name: str
    root: str

    def __post_init__(self):
        if self.name not in EXPERIMENTS:
            raise ValueError(f"experiment {self.name!r} is none of {', '.join(EXPERIMENTS)}")

    def _at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def dump(self, name: str) -> str:
        return self._at("raw", f"{name}.ttl.bz2")

    def table(self, name: str) -> str:
        return self._at("processed", name)

    def index(self, name: str) -> str:
        return self._at("indexes", name)

    def reference_terms(self) -> str:
        return self._at("input", f"reference_terms_{self.name}.csv")

    def gold(self) -> str:
        return self._at("input", f"gold_standard_{self.name}.csv")

    def result(self, name: str) -> str:
        return self._at("results", self.name, name)

    def create_local(self) -> None:
        """The folders, where the root is a local path; elsewhere writers make their own."""
        if "://" not in self.root:
            for part in ("raw", "processed", "indexes", "input", f"results/{self.name}"):
                Path(self.root, part).mkdir(parents=True, exist_ok=True)
