"""Sources, indexes, candidates, ranking and evaluation on hand-made graphs."""

import bz2
import io

import pytest
from pyspark.sql import functions as F
from termweave import config
from termweave.operators import candidates as C, features as E, indexes as I, ranking as R, scoring as S
from termweave.sources import download, ntriples, tables

D, P, RES = config.ONTOLOGY, config.PROPERTY, config.RESOURCE
LINES = [
    "# a comment",
    "",
    f'<{RES}Wine> <http://l> "Wine"@en .',
    f'<{RES}Q> <http://l> "say \\"hi\\"\\n<there>"@en .',
    f"<{RES}Wine> <http://t> <{D}Drink> .",
    f'<{RES}Wine> <{P}age> "5"^^<http://int> .',
    f'<{RES}Long> <{P}text> "' + "x" * 20_000 + '" .',
    f'<{RES}Wine> <{P}empty> "" .',
]


def lines(spark, tmp_path):
    path = tmp_path / "dump.ttl.bz2"
    path.write_bytes(bz2.compress("\n".join(LINES).encode()))
    return ntriples.lines(spark, str(path))


def test_ntriples(spark, tmp_path):
    rows = lines(spark, tmp_path)
    assert rows.count() == 6
    labels = {tuple(r) for r in ntriples.parsers()["labels"](rows).select("resource", "label").collect()}
    assert (RES + "Q", 'say "hi" <there>') in labels and (RES + "Long", "x" * 20_000) in labels and len(labels) == 4
    assert [tuple(r) for r in ntriples.parsers()["object_properties"](rows).where("property = 'http://t'").select("object").collect()] == [(D + "Drink",)]
    types = {r["class"] for r in ntriples.parsers(True)["instance_types"](rows).collect()}
    assert "http://t" in types and D + "Drink" not in types


def test_preprocess_reports_failures(spark, tmp_path):
    lines(spark, tmp_path)
    report = ntriples.preprocess(spark, {"labels": str(tmp_path / "dump.ttl.bz2"), "sameas_links": str(tmp_path / "none")}, lambda n: str(tmp_path / "out" / n))
    got = {r["relation"]: (r["status"].split(":")[0], r["rows"]) for r in report.collect()}
    assert got == {"labels": ("OK", 4), "sameas_links": ("FAILED", 0)}


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('entity_id,entity_type,label\nref:A,class,"a ""b""\nc"\nref:B,,\n', encoding="utf-8")
    rows = tables.read_csv(spark, str(path))
    assert [r["label"] for r in rows.collect()] == ['a "b"\nc', ""]
    assert [r["entity_id"] for r in tables.expand_terms(rows).collect()] == ["ref:A"]
    tables.write_csv(rows, str(tmp_path / "o"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "o")).collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        tables.write_csv(rows.where("false"), str(tmp_path / "e"))
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(path), required=["nothing"])
    with pytest.raises(ValueError):
        config.Experiment("other", "/tmp")


def test_download_resumes(tmp_path):
    body = b"0123456789"

    class Answer(io.BytesIO):
        def __init__(self, data, status):
            super().__init__(data)
            self.status, self.headers = status, {"Content-Length": str(len(body))}

    asked = []

    def opener(request, timeout):
        asked.append((request.get_method(), request.get_header("Range")))
        start = int((request.get_header("Range") or "bytes=0-")[6:-1])
        return Answer(b"" if request.get_method() == "HEAD" else body[start:], 206 if start else 200)

    path = tmp_path / "x.bz2"
    path.write_bytes(body[:4])
    assert download.fetch_retrying("http://h/x.bz2", path, opener, 0) and path.read_bytes() == body
    assert ("GET", "bytes=4-") in asked
    asked.clear()
    assert download.fetch("http://h/x.bz2", path, opener) and [m for m, _ in asked] == ["HEAD"]


def labels(spark):
    rows = [(1, RES + "A", "old"), (2, RES + "A", "Wine"), (3, RES + "B", "wine"), (4, RES + "Wine", "Other"), (5, RES + "C", "Wine"), (6, "", "Wine")]
    return spark.createDataFrame(rows, "seq long, resource string, label string").repartition(3)


def terms(spark):
    rows = [("ref:W", "class", "Wine"), ("ref:I", "individual", "Wine"), ("ref:m", "property", "hasMaker")]
    return tables.expand_terms(spark.createDataFrame(rows, "entity_id string, entity_type string, label string").coalesce(1)).withColumn("position", F.monotonically_increasing_id())


def test_indexes(spark):
    assert {tuple(r) for r in I.label_index(labels(spark)).collect()} >= {(RES + "A", "Wine"), (RES + "B", "wine")}
    got = {r["key"]: r["resources"] for r in I.normalized_label_index(labels(spark)).collect()}
    assert got["wine"] == [RES + "A", RES + "B", RES + "C"]
    facts = spark.createDataFrame([(1, "r", "p", "v"), (2, "r", "p", "v"), (3, "s", "q", "v")], "seq long, resource string, property string, value string")
    rel = {"literal": facts, "infobox": facts}
    assert [tuple(r) for r in I.ordered_frequency(I.property_frequency(rel)).collect()] == [("p", 4), ("q", 2)]


def test_caps_end_with_the_row(spark):
    """A row that gives two candidates is never cut in two; the order of partitions doesn't matter."""
    found = C.find_in_labels(terms(spark), labels(spark), cap=3).select("place.seq", "entity_id").collect()
    assert sorted(map(tuple, found)) == [(2, "ref:I"), (2, "ref:W"), (3, "ref:I"), (3, "ref:W")]
    assert C.find_in_labels(terms(spark), labels(spark)).count() == 8
    frequency = spark.createDataFrame([(P + "maker", 5, 1), (D + "maker", 5, 0), (P + "makers", 9, 2)], "property string, frequency long, first int")
    assert [r["candidate_uri"] for r in C.find_in_properties(terms(spark), frequency, cap=2).orderBy("place").collect()] == [P + "makers", D + "maker"]


def test_merge_and_ties(spark):
    base = C.scored(C.find_in_labels(terms(spark), labels(spark)))
    twice = base.unionByName(base)
    m = C.merged(twice)
    assert m.count() == C.merged(base).count()
    row = m.where(f"reference_entity_id = 'ref:I' and candidate_uri = '{RES}A'").first()
    assert row["strategies"] == ["exact_label", "expanded_label"] and row["strategy_count"] == 2 and row["evidence_source_count"] == 1
    tied = C.best_of_each(m.withColumn("initial_score", F.lit(0.5)).withColumn("strategy_count", F.lit(1)), 1)
    assert {r["candidate_uri"] for r in tied.collect()} == {RES + "A"}  # what was found first


def test_rank_and_evaluate(spark):
    types = spark.createDataFrame([(1, RES + "A", D + "Wine"), (2, RES + "B", D + "Wine")], "seq long, resource string, class string")
    facts = spark.createDataFrame([(1, RES + "A", P + "p", "v")], "seq long, resource string, property string, value string")
    frequency = I.property_frequency({"literal": facts})
    found = C.generate(terms(spark), labels(spark), types, frequency)
    featured = E.features(found, types, {"literal": facts}, frequency)
    ranked = R.rank(S.final(featured))
    best = {r["reference_entity_id"]: r["candidate_uri"] for r in R.best(ranked).collect()}
    assert best["ref:W"] == D + "Wine" and best["ref:m"] == D + "maker"
    gold = tables.gold(spark.createDataFrame([("ref:W", D + "Wine"), ("ref:W", D + "X"), ("ref:none", D + "Y")], "reference_entity_id string, expected_candidate_uri string"))
    got = {r["metric"]: r["value"] for r in R.metrics(R.details(ranked, gold, "expanded")).collect()}
    assert got == {"Precision@1": 0.5, "Precision@5": 0.5, "Precision@10": 0.5, "MRR": 0.5, "Coverage": 0.5, "Evaluated references": 2.0, "Missing predictions": 1.0}
    models = R.ablation_metrics(R.ablation_ranks(featured), gold, "expanded")
    assert models.count() == 12 * 7
