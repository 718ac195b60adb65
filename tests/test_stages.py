"""From .bz2 lines to the files of the ablation, as the command runs them."""

import bz2

import pytest
from pyspark.sql import functions as F
from termweave import config
from termweave.__main__ import main
from termweave.functions.text import lower_camel
from termweave.operators import candidates as C, joins
from termweave.sources import download, tables

D, P, RES = config.ONTOLOGY, config.PROPERTY, config.RESOURCE
DUMPS = {
    "labels": [f'<{RES}Wine> <http://l> "Wine"@en .', f'<{RES}Maker> <http://l> "Maker"@en .', f'<{RES}Chardonnay> <http://l> "Chardonnay"@en .'],
    "instance_types": [f"<{RES}Chardonnay> <http://t> <{D}Wine> .", f"<{RES}Q> <http://t> <{D}Wine> ."],
    "mappingbased_literals": [f'<{RES}Chardonnay> <{P}age> "5"^^<http://int> .', "# a comment", ""],
    "mappingbased_objects": [f"<{RES}Chardonnay> <{D}maker> <{RES}Maker> ."],
    "infobox_properties": [f'<{RES}Wine> <{P}region> "a, \\"b\\""@en .'],
    "commons_sameas_links": [f"<{RES}Wine> <http://same> <http://other/wine> ."],
}


@pytest.fixture
def root(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "raw").mkdir()
    terms = "entity_id,entity_type,label\nref:Wine,class,Wine\nref:m,property,hasMaker\nref:C,individual,Chardonnay\n"
    (tmp_path / "in/reference_terms_expanded.csv").write_text(terms)
    gold = f"reference_entity_id,reference_label,expected_candidate_uri,relation\nref:Wine,Wine,{D}Wine,equivalent\nref:C,Chardonnay,{RES}Chardonnay,equivalent\nref:none,None,{D}None,related\n"
    (tmp_path / "in/gold_standard_expanded.csv").write_text(gold)
    for name, lines in DUMPS.items():
        (tmp_path / f"raw/{name}.ttl.bz2").write_bytes(bz2.compress("\n".join(lines).encode()))
    return tmp_path


AFTER_DOWNLOAD = ["setup", "preprocess", "index", "candidates", "features", "rank", "evaluate", "ablation"]


def test_all_stages(spark, root):
    assert main(["expanded", str(root), *AFTER_DOWNLOAD, "--inputs", str(root / "in")], spark) == 0
    read = lambda name: tables.read_csv(spark, str(root / "results/expanded" / name))
    best = {r["reference_entity_id"]: r["candidate_uri"] for r in read("best_alignments").collect()}
    assert best["ref:Wine"] == D + "Wine" and best["ref:C"] == RES + "Chardonnay" and len(best) == 3
    metrics = {r["metric"]: float(r["value"]) for r in read("evaluation_metrics").collect()}
    assert metrics["Precision@1"] == 0.666667 and metrics["Missing predictions"] == 1
    assert read("ablation_metrics").count() == 12 * 7 and len(read("best_alignments").columns) == 56 and len(read("candidates").columns) == 16
    assert {r["status"] for s in AFTER_DOWNLOAD for r in read(f"manifest_{s}").collect()} == {"OK"}
    assert spark.read.parquet(str(root / "processed/sameas_links")).select("same_as").first()[0] == "http://other/wine"
    assert spark.read.parquet(str(root / "processed/infobox_properties")).select("value").first()[0] == 'a, "b"'


def test_failures_end_the_run(spark, root):
    assert main(["pilot", str(root), "candidates"], spark) == 1
    (root / "raw/labels.ttl.bz2").unlink()
    assert main(["expanded", str(root), "preprocess", "index", "--limit", "1"], spark) == 1
    rows = tables.read_csv(spark, str(root / "results/expanded/manifest_preprocess")).collect()
    assert {r["output"]: r["status"].split(":")[0] for r in rows}["labels"] == "FAILED" and len(rows) == 6
    assert not (root / "indexes/label_index").exists()
    with pytest.raises(SystemExit):
        main(["expanded", str(root), "nothing"], spark)


def test_row_limits_and_long_words(spark):
    """The limit of rows ends with the first matching row that reaches it; sources are read once."""
    labels = spark.createDataFrame([(k, f"{RES}R{k}", "Wine") for k in range(1, 9)], "seq long, resource string, label string").repartition(3)
    terms = C.positioned(tables.expand_terms(spark.createDataFrame([("ref:W", "class", "Wine")], "entity_id string, entity_type string, label string")))
    assert sorted(r[0] for r in C.find_in_labels(terms, labels, limit=4).select("place.seq").collect()) == [1, 2, 3, 4]
    assert sorted(r[0] for r in C.find_in_labels(terms, labels.where("seq % 3 <> 1"), limit=4).select("place.seq").collect()) == [2, 3, 5]
    words = " ".join(["ab"] * 1500)
    assert len(spark.range(1).select(lower_camel(F.lit(words))).first()[0]) == 3000
    assert download.file_name(config.dump_url("labels")) == "labels_lang=en.ttl.bz2" and len({config.dump_url(d) for d in config.DUMPS}) == 7


def test_sides_are_sent_by_their_bytes(spark):
    rows = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 1000))
    sent = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert sent(joins.sized(rows)) and not sent(joins.sized(rows, limit=99)) and not sent(joins.sized(rows, size=50_000))


def test_caps_read_a_source_once(spark):
    rows = spark.range(50).selectExpr("id div 3 as seq", "id as x").repartition(4)
    got = joins.first_up_to(rows, 7, whole=True)
    assert sorted(tuple(r) for r in got.collect()) == [(k // 3, k) for k in range(9)] and got.columns == ["seq", "x"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1
