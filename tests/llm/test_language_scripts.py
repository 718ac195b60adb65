"""Language identification in any script, against a plain hyperdimensional version."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from termweave.llm import _shared, language
from termweave.llm.queries import QUERIES

#: Two languages a script.
WORDS = {
    "ru": "это что как его она они был для все так если только когда уже или быть года может", "uk": "це що як його вона вони був для всі так якщо тільки коли вже або бути року може",
    "el": "και το να του η της με που την από για είναι τον στο δεν θα", "grc": "καὶ τὸ τοῦ τῆς δὲ μὲν γὰρ ἐν τῷ τὴν οὐκ τῶν ἀλλὰ πρὸς εἰς ἐπὶ",
    "ar": "في من على إلى أن هذا التي كان مع عن هذه الذي بعد كل قال", "fa": "در از که این را با است برای آن می شود یک کرد باید تا خود",
    "zh": "我们 他们 这个 没有 可以 什么 因为 中国 时候 知道", "ja": "東京 学校 先生 仕事 時間 日本 電車 新聞 料理 写真",
}


def corpus():
    rng, rows = random.Random(5), []
    for k in range(480):
        lang = list(WORDS)[k % len(WORDS)]
        rows.append((k, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(4, 40))), lang))
    return rows + [(1000, "1234 !!", "ru"), (1001, None, "uk"), (None, "это что", "ru"), (1002, "ж" * 50_000, None), (1003, "das", None)]


def letter(point):
    """A letter's vector, the long way."""
    if not point:
        return np.ones(language.DIMENSIONS, int)
    data = np.random.default_rng([language.SEED, point]).bytes(language.DIMENSIONS // 8)
    return np.array([2 * (byte >> (7 - bit) & 1) - 1 for byte in data for bit in range(8)])


def plain(text, known={}):  # noqa: B006
    total = np.zeros(language.DIMENSIONS, int)
    points = [0, *[ord(c) if c.isalpha() else 0 for c in text.lower()], 0]
    for k in range(1, len(points) - 1):
        if points[k]:
            a, b, c = (known.setdefault(p, letter(p)) if p not in known else known[p] for p in points[k - 1 : k + 2])
            total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_scripts_against_a_plain_version(spark, tmp_path):
    _shared.ship(spark)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "mine", 1.0, "mine") for r in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op9_language"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r["doc_id"]: r for r in got.collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    protos = {}
    for i, t, lang in rows:
        if i is not None and not held(i) and t and lang:
            protos[lang] = protos.get(lang, 0) + plain(t)
    names = sorted(protos)
    right = 0
    for i, t, lang in rows:
        assert got[i]["held_out"] == held(i)
        v = plain(t or "") if i != 1002 else plain("ж" * 5)  # a bundle of the same trigrams
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        if i == 1002:
            continue
        cosines = [float(protos[k] @ v / np.sqrt(float(protos[k] @ protos[k]) * float(v @ v))) for k in names]
        best = int(np.argmax(cosines))
        assert got[i]["lang_pred"] == names[best] and abs(got[i]["score"] - min(1, max(0, cosines[best]))) < 1e-6
        right += held(i) and i < 480 and lang == got[i]["lang_pred"]
    assert right >= 0.97 * sum(held(i) and i < 480 for i, t, lang in rows if lang and t)


def test_small_memory_and_many_languages(spark, monkeypatch):
    rows = corpus()[:200]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = language.fit(docs)
    for name, value in {"REMEMBERED": 40, "AT_ONCE": 16, "COUNTED": 100}.items():
        monkeypatch.setattr(language, name, value)
    small = language.Vectors()
    for _, t, _ in rows[:40]:
        assert (language.bundle(small, t) == plain(t)).all() and len(small.row) <= 40
    again = language.fit(docs.repartition(7))
    assert set(again) == set(whole) and all(np.allclose(again[k], whole[k]) for k in whole)
    with pytest.raises(ValueError):
        language.fit(docs.withColumn("lang", F.col("doc_id").cast("string")), languages=100)
