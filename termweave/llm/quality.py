"""Text quality by the votes of nearest labelled neighbours in a latent-semantic space.

A text's terms are its bytes and its hashed pairs of bytes, over the whole text, and how far back each word last came
(in powers of two), which tells prose from repetition. Their damped counts, of length one, are centred and projected
on the first singular vectors of the labelled sample: latent-semantic vectors. The labelled vectors, at most two times
PER_CLASS of RANK numbers whatever the corpus, go to every task; for each document the cosines with all of them come
from one exact matrix product a block, and the NEIGHBOURS nearest vote with the POWER-th power of their cosine.

Only the labelled sample is bounded: PER_CLASS labels of either kind, those with the least hash of their id, and as many
different texts of these.

Defined results: null and empty texts have the zero vector; their score, and any score without a neighbour of positive
cosine, is the sample's share of label 1 (equal shares: 0.5). Without any labelled row every score is 0.5. A label that
is null is not learned from; rows alike in id, text and label teach once. Repeated rows are scored each for itself. An
empty table gives an empty result. Only the named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import _shared

PAIRS, GAPS, GAP_WEIGHT = 1792, 24, 6.0
TERMS = 256 + PAIRS + GAPS
RANK, NEIGHBOURS, POWER = 32, 15, 4
PER_CLASS = 2048
CUT = 0.3
#: Documents whose cosines are computed at once.
BLOCK = 1024


def terms(text: str | None) -> np.ndarray:
    """Damped term counts of a whole text, of length one (zero for no text)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS, np.float32)
    if not data:
        return out
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out[:256] = np.bincount(b, minlength=256)
    if len(b) > 1:
        pair = ((b[:-1] << np.uint32(8) | b[1:]) * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(PAIRS)
        out[256 : 256 + PAIRS] = np.bincount(pair, minlength=PAIRS)
    last: dict[bytes, int] = {}
    gaps = [0] * GAPS
    for k, word in enumerate(data.split()):
        at = last.get(word)
        gaps[0 if at is None else min(GAPS - 1, (k - at).bit_length())] += 1
        last[word] = k
    np.log1p(out, out=out)
    out[256 + PAIRS :] = GAP_WEIGHT * np.log1p(gaps)
    return out / np.sqrt(out @ out)


class Space:
    """Latent-semantic vectors of labelled texts: mean, axes (TERMS x RANK), vectors, labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float64)
        self.mean = rows.mean(axis=0) if len(rows) else np.zeros(TERMS, np.float32)
        if len(rows):
            # the right singular vectors are the eigenvectors of the terms' scatter matrix
            centred = (rows - self.mean).astype(np.float64)
            values, axes = np.linalg.eigh(centred.T @ centred)
            axes = axes[:, ::-1][:, :RANK]
            self.axes = (axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)).astype(np.float32)
        else:
            self.axes = np.zeros((TERMS, RANK), np.float32)
        self.vectors = self.place(rows)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Terms -> latent vectors of length one; a text without terms has none."""
        found = (rows - self.mean) @ self.axes
        found[~rows.any(axis=1)] = 0
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cosines = self.place(rows) @ self.vectors.T
        n = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, n - 1, axis=1)[:, :n]
        votes = np.maximum(np.take_along_axis(cosines, near, 1).astype(np.float64), 0) ** POWER
        total = votes.sum(axis=1)
        yes = (votes * self.labels[near]).sum(axis=1)
        return np.clip(np.where(total > 1e-12, yes / np.maximum(total, 1e-12), self.labels.mean()), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Space:
    """labels: doc_id and `label` (0 or 1). Terms are counted where the texts are; TERMS numbers a sampled row come here."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    key = F.xxhash64(F.col("id").cast("string"))
    # ordered by hash within either label: top-n of both, kept small in every task
    sample = [known.where(F.col("label") == v).orderBy(key, "id").limit(per_class) for v in (0, 1)]
    picked = _shared.stable(sample[0].unionByName(sample[1]))
    # a labelled id may come in many rows: those alike are one, and again the first per_class of a label are taken
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("id", "label", "text", F.xxhash64("text").alias("hash"))
    texts = texts.dropDuplicates(["id", "label", "hash"])
    sample = [texts.where(F.col("label") == v).orderBy(key, "id", "hash").limit(per_class) for v in (0, 1)]
    texts = _shared.stable(sample[0].unionByName(sample[1])).repartition(16).select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [terms(t.as_py()).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(rows, pa.binary())], ["id", "label", "terms"])

    found = texts.mapInArrow(run, "id string, label int, terms binary").collect()
    found = sorted({(r["id"], bytes(r["terms"]), r["label"]) for r in found})
    rows = np.array([np.frombuffer(t, np.float32) for _, t, _ in found], np.float32).reshape(-1, TERMS)
    return Space(rows, np.array([v for _, _, v in found], np.float64))


def score(docs: DataFrame, space: Space, cut: float = CUT) -> DataFrame:
    """doc_id, score, predicted for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                found = sent.value.scores(np.array([terms(t.as_py()) for t in part.column(1)], np.float32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array((found >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    schema = StructType([docs.schema["doc_id"], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(column: Column) -> Column:
    """Documents whose label is not learned; a row without an id is not held out, and has no label."""
    return F.coalesce(_shared.id_bucket(column, 5) == 0, F.lit(False))
