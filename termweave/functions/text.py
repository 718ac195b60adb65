"""Text functions: Column to Column, built-ins only, so that they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import MAX_VARIANTS, PROPERTY_PREFIXES, STEM_SUFFIXES, STOP_WORDS, SYNONYMS, TYPE_NAMES


def strip(c: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """hasMaker, wine_region, Cabernet-Sauvignon -> has maker, wine region, cabernet sauvignon. Letters a-z and digits stay."""
    split = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(split), "[^a-z0-9]+", " "))


def normalize_for_index(c: Column) -> Column:
    """The indexes' variant: no camel case, hyphens stay."""
    spaced = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "_", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[^a-z0-9\s-]", " "), r"\s+", " "))


def tokens(normalized: Column) -> Column:
    """The words of a normalized text; none for the empty one."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


#: The list's order is that of length wherever one suffix ends with another, so the longest that leaves three letters is the first.
_STEM = "^(.{3,}?)(?:" + "|".join(STEM_SUFFIXES) + ")$"


def stem(token: Column) -> Column:
    """A normalized token without the first suffix, in the fixed order, that leaves three letters or more; ies becomes y."""
    return F.when(F.rlike(token, F.lit("^.{3,}ies$")), F.regexp_replace(token, "ies$", "y")).otherwise(F.regexp_replace(token, _STEM, "$1"))


def stems(normalized: Column) -> Column:
    return F.transform(tokens(normalized), stem)


def normalize_type(c: Column) -> Column:
    """class, property, individual; else the normalized name itself, or unknown."""
    n = normalize_text(c)
    first, *rest = TYPE_NAMES.items()
    out = F.when(n.isin(*first[1]), first[0])
    for name, spellings in rest:
        out = out.when(n.isin(*spellings), name)
    return out.when(n == "", "unknown").otherwise(n)


def camel(normalized: Column) -> Column:
    """wine region -> WineRegion."""
    return F.replace(F.initcap(normalized), F.lit(" "), F.lit(""))


def lower_camel(normalized: Column) -> Column:
    """wine region -> wineRegion."""
    words = tokens(normalized)
    rest = F.array_join(F.transform(F.slice(words, F.lit(2), F.size(words)), F.initcap), "")
    return F.coalesce(F.concat(F.try_element_at(words, F.lit(1)), rest), F.lit(""))


def without_prefixes(normalized: Column) -> Column:
    """Array: the text, and what is left of it after each prefix that it begins with."""
    fitting = F.filter(_words(PROPERTY_PREFIXES), lambda p: F.startswith(normalized, p))
    cut = F.transform(fitting, lambda p: F.trim(F.substr(normalized, F.length(p) + 1)))
    return F.filter(F.concat(F.array(normalized), cut), lambda x: x != "")


def _words(values) -> Column:
    """An array of literals, in one call."""
    return F.expr(f"array({', '.join(repr(v) for v in values)})")


def with_synonyms(variants: Column) -> Column:
    """Array: the variants, then the synonyms of each and of its words; one pass."""
    entries = (f"{k!r}, array({', '.join(map(repr, v))})" for k, v in SYNONYMS.items())
    known, none = F.expr(f"map({', '.join(entries)})"), F.expr("cast(array() as array<string>)")
    keys = F.flatten(F.transform(variants, lambda v: F.concat(F.array(v), tokens(v))))
    found = F.flatten(F.transform(keys, lambda k: F.coalesce(F.try_element_at(known, k), none)))
    return F.array_distinct(F.concat(variants, found))


def variants(label: Column) -> Column:
    """The expanded terms of a label, in order: whole, without prefixes, words, stems, joined stems, content words, synonyms."""
    whole = normalize_text(label)
    words = tokens(whole)
    long = F.filter(words, lambda t: F.length(t) > 2)
    stemmed = F.transform(long, stem)
    content = F.filter(words, lambda t: ~F.array_contains(_words(STOP_WORDS), t))
    parts = F.concat(F.array(whole), without_prefixes(whole), long, stemmed, F.array(F.array_join(stemmed, " ")), F.array(F.array_join(content, " ")), content)
    own = F.array_distinct(F.filter(parts, lambda x: x != ""))
    return F.slice(with_synonyms(own), 1, MAX_VARIANTS)
