"""Language identification by hyperdimensional profiles.

Every letter of Unicode has a random vector of +1 and -1, drawn from its code point. A letter trigram's vector binds the
three, permuted by their place: roll(a, 2) * roll(b, 1) * c; what is no letter binds as the identity. A text's vector
bundles (adds) those of all its trigrams; a language's prototype bundles those of all its training texts. The language
whose prototype has the largest cosine with the text's vector is predicted. Bundling is linear, so training needs only
trigram counts, over every training row.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text when nothing could be
learned. A null language or id is not learned from. Ties between languages go to the smaller name. Repeated rows
count each time. An empty table gives an empty result. Only the named columns are looked at. More than LANGUAGES
different languages to learn are an error: one vector each comes to the driver, and a column of so many holds no languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _shared

DIMENSIONS = 2048
SEED = 20240229
#: Different languages that can be learned.
LANGUAGES = 1024
#: Trigram vectors, and letter vectors, that a worker remembers; trigrams bundled at once; trigram counts that a task holds.
REMEMBERED, AT_ONCE, COUNTED = 1 << 14, 1 << 12, 1 << 19
#: Vectors added up at once, so that they stay near the processor.
CACHED = 96
#: Bits of a code point in a trigram's number.
BITS = 21
UNKNOWN = "und"
#: A text of so many different trigrams is unlike every language below so many deviations of a random vector's cosine,
#: 1 / sqrt(dimensions); in fewer trigrams clean texts score no more than noise.
TOLD, DEVIATIONS = 50, 4.0
_state: dict = {}


def _letters() -> np.ndarray:
    """Code point -> is it a letter?"""
    if "letters" not in _state:
        table = np.zeros(0x110000, bool)
        table[[p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and chr(p).isalpha()]] = True
        _state["letters"] = table
    return _state["letters"]


def trigrams(text: str) -> np.ndarray:
    """The numbers of all letter trigrams of a whole text, in order; words are set off by one boundary."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.zeros(len(points) + 2, np.int64)
    s[1:-1] = np.where(_letters()[points], points, 0)
    return ((s[:-2] << 2 * BITS) | (s[1:-1] << BITS) | s[2:])[s[1:-1] > 0]


class Vectors:
    """Letter and trigram vectors, made when first needed; REMEMBERED of each at most are kept."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.made = np.zeros((1024, dimensions), np.int8)

    def letter(self, point: int) -> np.ndarray:
        found = self.letters.get(point)
        if found is None:
            if len(self.letters) >= REMEMBERED:
                self.letters.clear()
            bits = np.frombuffer(np.random.default_rng([self.seed, point]).bytes(-(-self.dimensions // 8)), np.uint8)
            # a boundary binds as the identity
            found = np.unpackbits(bits)[: self.dimensions].astype(np.int8) * 2 - 1 if point else np.ones(self.dimensions, np.int8)
            self.letters[point] = found
        return found

    def _place(self, points: np.ndarray, shift: int) -> np.ndarray:
        values, which = np.unique(points, return_inverse=True)
        return np.roll(np.array([self.letter(p) for p in values.tolist()], np.int8), shift, 1)[which]

    def places(self, grams: np.ndarray) -> np.ndarray:
        """Where the vectors of AT_ONCE different trigrams at most are, made if they are new."""
        row = self.row
        new = [g for g in grams.tolist() if g not in row]
        if new:
            if len(row) + len(new) > REMEMBERED:
                row.clear()
                new = grams.tolist()
            n, mask = len(row), (1 << BITS) - 1
            if n + len(new) > len(self.made):
                more = max(len(self.made), n + len(new) - len(self.made))
                self.made = np.concatenate([self.made, np.zeros((more, self.dimensions), np.int8)])
            g = np.array(new, np.int64)
            self.made[n : n + len(new)] = self._place(g >> 2 * BITS, 2) * self._place(g >> BITS & mask, 1) * self._place(g & mask, 0)
            row.update(zip(new, range(n, n + len(new)), strict=True))
        return np.array([row[g] for g in grams.tolist()], np.int64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of AT_ONCE different trigrams at most, a row each."""
        return self.made[self.places(grams)]

    def bundle(self, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sum of the vectors of different trigrams, each n times."""
        total = np.zeros(self.dimensions)
        for k in range(0, len(grams), AT_ONCE):
            places, times = self.places(grams[k : k + AT_ONCE]), n[k : k + AT_ONCE]
            # float32 is exact as long as no sum outgrows its 24 bits
            kind = np.float32 if times.sum() < 1 << 24 else np.float64
            for a in range(0, len(places), CACHED):
                total += times[a : a + CACHED].astype(kind) @ self.made[places[a : a + CACHED]].astype(kind)
        return total


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams and how often each comes."""
    s = np.sort(grams)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
    return s[first], np.diff(np.append(first, len(s)))


def bundle(vectors: Vectors, text: str) -> np.ndarray | None:
    grams, n = counted(trigrams(text))
    return vectors.bundle(grams, n) if len(grams) else None


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(which, np.concatenate([n for _, n in parts])).astype(np.int64)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED, languages: int = LANGUAGES) -> dict[str, np.ndarray]:
    """Language -> prototype, from every row with a text and a language. Tasks send one vector a language, never texts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, held, size = Vectors(dimensions, seed), {}, 0

        def out():
            for name, parts in sorted(held.items()):
                total = vectors.bundle(*_merged(parts))
                yield pa.RecordBatch.from_pydict({"lang": [name] * dimensions, "at": np.arange(dimensions, dtype=np.int32), "n": total.astype(np.int64)})
            held.clear()

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts = held.setdefault(name, [])
                parts.append(counted(trigrams(t.as_py())))
                size += len(parts[-1][0])
                if size > COUNTED:  # most are alike
                    held.update((k, [_merged(v)]) for k, v in list(held.items()))
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > COUNTED // 2:
                        yield from out()
                        size = 0
        yield from out()

    use = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    if use.select("lang").distinct().limit(languages + 1).count() > languages:
        raise ValueError(f"{lang} holds more than {languages} different values: no languages")
    parts = use.mapInArrow(sums, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for r in parts.toLocalIterator():  # dimensions rows a language
        found.setdefault(r["lang"], np.zeros(dimensions))[r["at"]] = r["n"]
    return {k: v / np.sqrt(v @ v) for k, v in sorted(found.items()) if v @ v > 0}


def _stacked(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The languages in order, and their prototypes, a row each; no rows if nothing was learned."""
    names = sorted(prototypes)
    return names, np.array([prototypes[k] for k in names], np.float64) if names else np.zeros((0, DIMENSIONS))


def classify(batches: Iterator[pa.RecordBatch], at: int, names: list[str], prototypes: np.ndarray, seed: int) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, np.ndarray]]:
    """Each batch, with the language, score and number of different trigrams of the text in its column `at`."""
    vectors = Vectors(prototypes.shape[1] if len(names) else DIMENSIONS, seed)
    for batch in batches:
        langs, scores, told = [], np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for k, t in enumerate(batch.column(at)):
            langs.append(UNKNOWN)
            grams, n = counted(trigrams(x)) if names and (x := t.as_py()) else ((), ())
            told[k] = len(grams)
            v = vectors.bundle(grams, n) if len(grams) else None
            if v is not None and (length := float(np.sqrt(v @ v))) > 0:
                cosines = prototypes @ v / length
                best = int(np.argmax(cosines))
                langs[-1], scores[k] = names[best], min(1.0, max(0.0, float(cosines[best])))
        yield batch, langs, scores, told


def predict(rows: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", seed: int = SEED) -> DataFrame:
    """rows, with lang_pred string and score double in place of the text. The prototypes are one vector a language."""
    names, matrix = _stacked(prototypes)
    kept = [c for c in rows.columns if c != text]

    def run(batches):
        for batch, langs, scores, _ in classify(batches, len(kept), names, matrix, seed):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores)], [*kept, "lang_pred", "score"])

    schema = rows.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", "string").add("score", "double")
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(text)).mapInArrow(run, schema)


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs; the rows where `learn` holds teach."""
    prototypes = fit(docs.where(learn))
    return predict(docs.select("doc_id", "text"), prototypes)


def identified_documents(docs: DataFrame, deviations: float = DEVIATIONS, told: int = TOLD) -> DataFrame:
    """The documents of docs, whole, whose language is known: a letter at least, and a cosine with a prototype that is
    above 0, and above `deviations` of noise in texts of `told` different trigrams or more.

    Learns from every row that has a language. Where no row has one, nothing can be learned and nothing is rejected
    for its score; texts without letters still go.
    """
    prototypes = fit(docs)
    names, matrix = _stacked(prototypes)
    at = docs.columns.index("text")

    def run(batches):
        for batch, langs, scores, n in classify(batches, at, names, matrix, SEED):
            if names:
                least = np.where(n >= told, deviations / np.sqrt(matrix.shape[1]), 0.0)
                keep = [a != UNKNOWN and ok for a, ok in zip(langs, (scores > least).tolist(), strict=True)]
            else:
                keep = [bool(x) and any(map(str.isalpha, x)) for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: Column) -> Column:
    """Documents that nothing is learned from; a row without an id is neither learned from nor held out."""
    return F.coalesce(_shared.id_bucket(column, 3) == 1, F.lit(False))


def learnable(column: Column) -> Column:
    return F.coalesce(_shared.id_bucket(column, 3) != 1, F.lit(False))
