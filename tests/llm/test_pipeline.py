"""The pipeline's stages one after another, each held against what it should have kept."""

import collections
import re

import corpus_pipeline
import numpy as np
from test_operators import DOCS, least_labels, slow_cut, slow_fingerprint, some_docs
from tokenizers import Tokenizer
from termweave.llm.queries import tokenizer_path


def test_stages(spark, tmp_path):
    rows = [r for r in some_docs(60, 5) if r[0] is not None and r[0] != 1]
    rows = list({r[0]: r for r in rows}.values())
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.collect())
    identified, unique, stripped, mixed, pieces = kept
    assert {r["doc_id"] for r in identified} == {r[0] for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])}
    identified.sort(key=lambda r: r["doc_id"])
    label = least_labels([slow_fingerprint(r["text"]) for r in identified])
    assert {r["doc_id"] for r in unique} == {identified[k]["doc_id"] for k in set(label)}
    unique.sort(key=lambda r: r["doc_id"])
    want = {r["doc_id"]: left.decode("utf-8", "ignore") for r, (left, _, _) in zip(unique, slow_cut([r["text"].encode() for r in unique]), strict=True)}
    assert {r["doc_id"]: r["text"] for r in stripped} == want
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows)
    assert abs(words(mixed) - 1.5 * words(stripped)) < 10
    tok = Tokenizer.from_file(tokenizer_path())
    tokens = collections.Counter(x for r in mixed for x in [*tok.encode(r["text"], add_special_tokens=False).ids, 1])
    packed = collections.Counter(x for r in pieces for x in np.frombuffer(r["ids"], "<u4").tolist())
    assert packed == tokens


def test_whole_run(spark, tmp_path):
    spark.createDataFrame(some_docs(30, 6), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
