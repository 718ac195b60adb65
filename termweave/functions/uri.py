"""URI functions and the name-space tests; the base URIs are settings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import ONTOLOGY, PROPERTY, RESOURCE
from .text import camel, lower_camel, normalize_text


def last_token(uri: Column) -> Column:
    """What follows the last / or #, those at the end not counted."""
    return F.element_at(F.split(F.regexp_replace(F.coalesce(uri, F.lit("")), "[/#]+$", ""), "[/#]"), -1)


def namespace(uri: Column) -> Column:
    return (
        F.when(F.coalesce(uri, F.lit("")) == "", "unknown")
        .when(F.contains(uri, F.lit("/resource/")), "resource")
        .when(F.contains(uri, F.lit("/ontology/")), "ontology")
        .when(F.contains(uri, F.lit("/property/")), "property")
        .otherwise("other")
    )


def _initial(uri: Column) -> Column:
    return F.left(last_token(uri), F.lit(1))


def is_class(uri: Column) -> Column:
    c = _initial(uri)
    return F.startswith(uri, F.lit(ONTOLOGY)) & (F.upper(c) == c) & (F.lower(c) != c)


def is_ontology_property(uri: Column) -> Column:
    c = _initial(uri)
    return F.startswith(uri, F.lit(ONTOLOGY)) & (F.lower(c) == c) & (F.upper(c) != c)


def is_raw_property(uri: Column) -> Column:
    return F.startswith(uri, F.lit(PROPERTY))


def is_property(uri: Column) -> Column:
    return is_ontology_property(uri) | is_raw_property(uri)


def is_resource(uri: Column) -> Column:
    return F.startswith(uri, F.lit(RESOURCE))


def kind(uri: Column) -> Column:
    """class, ontology_property, raw_property, resource or other; no URI is two of them."""
    token = F.left(last_token(uri), F.lit(1))
    cased = F.when(~F.startswith(uri, F.lit(ONTOLOGY)), "").when(F.upper(token) == F.lower(token), "").when(F.upper(token) == token, "class").when(F.lower(token) == token, "ontology_property").otherwise("")
    return F.when(cased != "", cased).when(is_raw_property(uri), "raw_property").when(is_resource(uri), "resource").otherwise("other")


PROPERTY_KINDS = ("ontology_property", "raw_property")


def _named(base: str, name: Column) -> Column:
    return F.when(name != "", F.concat(F.lit(base), name)).otherwise("")


def class_uri(term: Column) -> Column:
    return _named(ONTOLOGY, camel(normalize_text(term)))


def ontology_property_uri(term: Column) -> Column:
    return _named(ONTOLOGY, lower_camel(normalize_text(term)))


def raw_property_uri(term: Column) -> Column:
    return _named(PROPERTY, F.replace(normalize_text(term), F.lit(" "), F.lit("_")))


def resource_uri(term: Column) -> Column:
    return _named(RESOURCE, camel(normalize_text(term)))


def file_name(url: Column) -> Column:
    """The last part of a URL's path."""
    return F.element_at(F.split(F.parse_url(url, F.lit("PATH")), "/"), -1)
