"""The queries themselves, every column, on a folder with nulls, repeats, long texts and clashing names."""

import collections
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from termweave.llm import _shared, quality, warc
from termweave.llm.queries import QUERIES, tokenizer_path
from test_operators import DOCS, least_labels, slow_cut, slow_fingerprint, some_docs, text_of

#: Names that operators and stages use themselves.
NAMES = (
    "row words whole taken rows drawn_id size key range range_start source_size target no_source source_ label hash id terms k1 k2 marks spans mark span h1 h2 kp flag kind at left around "
    "edge other fp root component_id text_hash least keys tie u v part nodes first child n __n __id __hash __text __size __share __words __taken __rows __source __k1 __k2 __marks __spans "
    "ids start length doc_tokens sequence_id offset lang_pred score predicted media feature path host payload removed low page page_id digest refers_to"
).split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, at = some_docs(80, 3), tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in NAMES})
    docs.repartition(4).write.parquet(str(at / "documents.parquet"))
    labels = [(i, (i // 3) % 2, None) for i in range(80)] + [(1, None, 1), (None, 1, 0), (1, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({c: F.lit("mine") for c in ("label", "id", "text")}).write.parquet(str(at / "labels.parquet"))
    return rows, str(at)


def counted(rows, names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows)


def test_quality(spark, folder):
    rows, at = folder
    got = QUERIES["op2_quality"](spark, at)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(r[0] for r in rows)
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    space = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    learned = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5]
    texts = {(i, t) for i, t in text_of(rows) if i in learned}
    assert len(space.labels) == len(texts) + sum(i == 1 and 1 in learned for i, _ in texts)  # id 1 has both labels
    want = {t: float(space.scores(np.array([quality.terms(t)], np.float32))[0]) for _, t in text_of(rows)}
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert min(abs(r["score"] - want[t]) for i, t in text_of(rows) if i == r["doc_id"]) < 1e-5 and r["predicted"] == int(r["score"] >= 0.3)


def test_a_labelled_id_in_many_rows(spark):
    docs = spark.createDataFrame([(1, "the same text")] * 50 + [(1, f"text {k}") for k in range(50)] + [(2, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(quality.fit(docs, labels).labels) == 52 and len(quality.fit(docs, labels, per_class=10).labels) == 11


def test_simhash(spark, folder):
    rows, at = folder
    got = counted(QUERIES["op5_simhash"](spark, at).collect(), ["doc_id", "fingerprint", "component_id"])
    fps = [slow_fingerprint(t) for _, t in text_of(rows)]
    label = least_labels(fps)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(text_of(rows)):
        if i is not None:
            least[label[k]].append(i)
    assert got == collections.Counter((i, f"{fps[k]:016x}", min(least[label[k]], default=None)) for k, (i, _) in enumerate(text_of(rows)))


def test_packing(spark, folder):
    from tokenizers import Tokenizer

    rows, at = folder
    tok = Tokenizer.from_file(tokenizer_path())
    pieces = QUERIES["op6_packing"](spark, at).collect()
    assert list(pieces[0].asDict()) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    by = collections.defaultdict(list)
    for r in pieces:
        by[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    texts = collections.defaultdict(list)
    for i, t in text_of(rows):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        texts[i, len(ids)].append(ids)
    assert set(by) == set(texts)
    for key, found in by.items():
        assert sum(n for _, n, _ in found) == key[1] * len(texts[key])
        data = [np.array(ids, "<u4") for ids in texts[key]]
        for start, n, crc in found:
            assert crc in {zlib.crc32(ids[start : start + n].tobytes()) for ids in data}
        covered = collections.Counter(k for start, n, _ in found for k in range(start, start + n))
        assert covered == collections.Counter({k: len(data) for k in range(key[1])})


def test_suffixes(spark, folder):
    rows, at = folder
    got = counted(QUERIES["op7_suffixes"](spark, at).collect(), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    texts = [t.encode() for _, t in text_of(rows)]
    assert got == collections.Counter((rows[k][0], len(texts[k]), gone, spans, hashlib.sha256(kept).hexdigest()) for k, (kept, gone, spans) in enumerate(slow_cut(texts)))


def test_warc(spark, tmp_path):
    rng = random.Random(1)
    page = lambda n: "".join(rng.choice("abcde é<>") for _ in range(n))
    rows = [(i, f"http://h/{i}", page(rng.randint(0, 400))) for i in range(120)] + [(200, None, None), (201, "u", page(500_000)), (7, "again", page(300)), (None, "u", page(200))]
    rows += [(300 + i, "copy", rows[k][2]) for i, k in enumerate((3, 5, 3, 121, 121))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("mine") for c in NAMES if c != "page_id"}).repartition(4)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = collections.Counter()
    for i, _, h in rows:
        data, first = (h or "").encode(), least.get(h or "")
        copy = len(data) >= 100 and first is not None and first != i
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", first if copy else None] += 1
    assert counted(QUERIES["op4_warc"](spark, str(tmp_path)).collect(), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]) == want
    # index first: a selection is read, and only that
    at = _shared.fresh_dir(spark, "some")
    index = warc.write(warc.marked(pages), at)
    some = index.where("page_id % 10 = 3 and record_type = 'response'")
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read(some, at).collect()}
    assert got == {i: (h or "").encode() for i, _, h in rows if i is not None and i % 10 == 3 and not (i >= 300)}
    with pytest.raises(ValueError):
        warc.write(warc.marked(pages), "wasbs://x@y/z")


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_take_any_column(spark, folder, at, tmp_path):
    """Each stage gives with clashing columns what it gives without, and takes an empty table."""
    rows, _ = folder
    plain = spark.createDataFrame(rows, DOCS).repartition(2)
    plain.write.parquet(str(tmp_path / "plain"))
    plain = spark.read.parquet(str(tmp_path / "plain"))
    clashing, stage = plain.withColumns({c: F.lit("mine") for c in NAMES}), corpus_pipeline.STAGES[at][1]
    names = plain.columns if at < len(corpus_pipeline.STAGES) - 1 else ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    want, got = stage(spark, plain, ""), stage(spark, clashing, "")
    if at < len(corpus_pipeline.STAGES) - 1:
        assert want.columns == plain.columns and got.columns == clashing.columns and got.where("k1 <> 'mine' or row <> 'mine' or __size <> 'mine'").isEmpty()
        assert counted(got.collect(), names) == counted(want.collect(), names)
    else:
        assert sum(r["length"] for r in got.collect()) == sum(r["length"] for r in want.collect())
    assert stage(spark, clashing.where("false"), "").isEmpty()
