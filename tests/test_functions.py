"""Text, URI, similarity and number functions against a plain Python reading of their definitions."""

import random

from pyspark.sql import functions as F
from termweave import config
from termweave.functions import numeric as N, similarity as sim, text as T, uri as U


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def py_stem(token):
    for s in config.STEM_SUFFIXES:
        if token.endswith(s) and len(token) > len(s) + 2:
            return token[: -len(s)] + ("y" if s == "ies" else "")
    return token


def test_normalize(spark):
    rows = ["hasMaker", "wine_region", "Cabernet-Sauvignon", None, "", " \t Éa1 ", "ABCd"]
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    got = [tuple(r) for r in df.select(T.normalize_text(F.col("x")), T.normalize_for_index(F.col("x"))).collect()]
    assert [a for a, _ in got] == ["has maker", "wine region", "cabernet sauvignon", "", "", "a1", "abcd"]
    assert got[2][1] == "cabernet-sauvignon" and got[0][1] == "hasmaker" and got[1][1] == "wine region"


def test_stem_is_the_ordered_list(spark):
    rng = random.Random(3)
    words = ["location", "creator", "paris", "as", "pies", "ties", "cities", "classes", "less", "kinglies", "hopefulness"]
    words += ["".join(rng.choice("abies") for _ in range(rng.randint(0, 4))) + rng.choice(config.STEM_SUFFIXES) + rng.choice(["", "s", "ed", "es"]) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r[0]: r[1] for r in df.select("w", T.stem(F.col("w"))).collect()}
    assert got == {w: py_stem(w) for w in words}
    assert (got["location"], got["creator"], got["paris"]) == ("loc", "cre", "pari")


def test_variants_in_order(spark):
    got = one(spark, T.variants(F.col("x")), x="hasMaker")
    assert got[:3] == ["has maker", "maker", "has"] and got[-1] == "manufactured by" and len(got) == len(set(got))
    assert "manufacturer" in got and one(spark, T.variants(F.col("x")), x="  ") == []


def test_similarities_at_the_edges(spark):
    pairs = [("", ""), ("", "a"), ("wine", "wine"), ("w", "wine"), ("abc", "xyz"), ("wine region", "region wine")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = sim.forms(F.col("a")), sim.forms(F.col("b"))
    got = [tuple(r) for r in df.select(*[f(a, b) for f in (sim.levenshtein, sim.token_jaccard, sim.stem_jaccard, sim.bigram_jaccard, sim.prefix, sim.containment)]).collect()]
    assert got[0] == (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert got[1] == (0.0,) * 6
    assert got[2] == (1.0,) * 6
    assert got[3][4] == 1.0 and got[3][5] == 0.25
    assert got[4] == (0.0,) * 6
    assert got[5][1] == 1.0 and got[5][0] < 1


def test_uris(spark):
    d, p, r = config.ONTOLOGY, config.PROPERTY, config.RESOURCE
    rows = [(d + "Wine", "class"), (d + "region", "ontology_property"), (p + "x", "raw_property"), (r + "Wine", "resource"), ("http://e.org/#A/", "other"), (d + "1a", "other")]
    df = spark.createDataFrame(rows, "u string, k string")
    u = F.col("u")
    got = df.select("k", U.kind(u), U.is_class(u), U.is_ontology_property(u), U.is_raw_property(u), U.is_resource(u)).collect()
    for k, kind, *tests in got:
        assert kind == k and tests == [k == x for x in ("class", "ontology_property", "raw_property", "resource")]
    assert one(spark, U.last_token(F.col("x")), x="http://e.org/#A/") == "A"
    assert one(spark, U.ontology_property_uri(F.col("x")), x="wine region") == d + "wineRegion"
    assert one(spark, U.class_uri(F.col("x")), x="") == ""


def test_numbers(spark):
    assert one(spark, N.to_float(F.col("x")), x="abc") == 0.0
    assert one(spark, N.to_int(F.col("x")), x="-3.9") == -3
    assert one(spark, N.size_text(N.to_float(F.col("x"))), x=str(3 << 30)) == "3.00 GB"


def test_no_python_in_any_plan(spark):
    df = spark.createDataFrame([("Wine", "wines")], "a string, b string").select(T.variants(F.col("a")), sim.stem_jaccard(sim.forms(F.col("a")), sim.forms(F.col("b"))))
    assert "Python" not in df._jdf.queryExecution().toString()
