"""Similarities of two normalized texts, all in [0, 1].

A text's forms - words, stems, pairs of letters - are computed once, as columns, and then compared as often as needed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .numeric import round6
from .text import stem, tokens


@dataclass(frozen=True)
class Forms:
    text: Column
    words: Column
    stems: Column
    pairs: Column


def forms(a: Column) -> Forms:
    return Forms(a, tokens(a), F.transform(tokens(a), stem), bigrams(a))


def with_forms(rows: DataFrame, *texts: str) -> tuple[DataFrame, list[Forms]]:
    """rows with the forms of each of these columns of normalized text, as columns to be dropped by their names' `__`."""
    rows = rows.withColumns({f"__{t}_words": tokens(F.col(t)) for t in texts} | {f"__{t}_pairs": bigrams(F.col(t)) for t in texts})
    rows = rows.withColumns({f"__{t}_stems": F.transform(f"__{t}_words", stem) for t in texts})
    return rows, [Forms(*[F.col(c) for c in (t, f"__{t}_words", f"__{t}_stems", f"__{t}_pairs")]) for t in texts]


def without_forms(rows: DataFrame, *texts: str) -> DataFrame:
    return rows.drop(*[f"__{t}_{f}" for t in texts for f in ("words", "stems", "pairs")])


def levenshtein(x: Forms, y: Forms) -> Column:
    a, b = x.text, y.text
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def token_jaccard(x: Forms, y: Forms) -> Column:
    return jaccard(x.words, y.words)


def stem_jaccard(x: Forms, y: Forms) -> Column:
    return jaccard(x.stems, y.stems)


def bigrams(a: Column) -> Column:
    """Pairs of letters, spaces left out; a single letter stands for itself."""
    solid = F.replace(a, F.lit(" "), F.lit(""))
    n = F.length(solid)
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n == 1, F.array(solid))
        .otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(solid, i, F.lit(2))))
    )


def bigram_jaccard(x: Forms, y: Forms) -> Column:
    return jaccard(x.pairs, y.pairs)


def prefix(x: Forms, y: Forms) -> Column:
    """The common beginning, by the shorter length."""
    a, b = x.text, y.text
    short = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(short, F.lit(1))), lambda i: F.left(a, i) == F.left(b, i)))
    return F.when(short == 0, 0.0).otherwise(same / F.greatest(short, F.lit(1)))


def containment(x: Forms, y: Forms) -> Column:
    a, b = x.text, y.text
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = F.contains(a, b) | F.contains(b, a)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(inside, shorter / F.greatest(longer, F.lit(1))).otherwise(0.0)


def initial(reference: Forms, label: Forms, token: Forms) -> Column:
    """The first score of a candidate: its label, and its URI's last token, against the reference."""
    return round6(
        0.25 * levenshtein(reference, label)
        + 0.20 * token_jaccard(reference, label)
        + 0.15 * stem_jaccard(reference, label)
        + 0.15 * bigram_jaccard(reference, label)
        + 0.10 * prefix(reference, label)
        + 0.10 * levenshtein(reference, token)
        + 0.05 * token_jaccard(reference, token)
    )
