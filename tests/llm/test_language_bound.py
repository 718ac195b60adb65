"""The pipeline's language stage rejects noise in any script and keeps what is short."""

import random

from termweave.llm import _shared, language


def test_noise_is_rejected(spark):
    _shared.ship(spark)
    rng = random.Random(4)
    say = lambda words: " ".join(rng.choice(words) for _ in range(60))
    en, de = "the river house of morning and people winter would there".split(), "der die und das häuser zwischen straße größer".split()
    clean = [(k, say(en if k % 2 else de), "en" if k % 2 else "de") for k in range(60)]
    clean += [(100, "the", "en"), (101, "die häuser", None), (102, "the river. the river. the river.", None)]
    noise = []
    for k in range(150):
        letters = ("bcdfghjklmnpqrstvwxz", [chr(c) for c in range(0x430, 0x450)], [chr(c) for c in range(0x4E00, 0x9000)])[k % 3]
        noise.append((1000 + k, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(40)), None))
    docs = spark.createDataFrame(clean + noise, "doc_id long, text string, lang string").repartition(4)
    kept = {r["doc_id"] for r in language.identified_documents(docs).collect()}
    assert {r[0] for r in clean} <= kept and len(kept) - len(clean) < 0.02 * len(noise)
