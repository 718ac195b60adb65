"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from termweave.llm import _shared, language, media, mixing, neighbours, packing, pagetext, quality, simhash, suffixes, warc
from termweave.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some_docs(n=120, seed=1):
    """Prose in two languages with copies, near copies, shared passages, nulls, blanks, a very long text and clashing columns."""
    rng = random.Random(seed)
    en = "the of and that with for this from have which their would there about river house morning little people winter".split()
    de = "der die und das nicht mit sich auf für eine über schön größer während zwischen straße häuser können müssen jahre".split()
    say = lambda ws, k: " ".join(rng.choice(ws) for _ in range(k))
    passage = say(en, 60)
    rows = []
    for i in range(n):
        ws, lang = (de, "de") if i % 3 == 0 else (en, "en")
        text = say(ws, rng.randint(5, 120))
        if i % 10 == 4:
            text = f"{text[:80]} {passage} {say(ws, 20)}"
        if i % 11 == 5:
            text = rows[-1][1]
        rows.append((i, text, lang, ["a", "b", None, "c"][i % 4] if i % 5 else "a", len(text or "")))
    rows += [(n, None, None, "a", None), (n + 1, "", "en", "b", 0), (n + 2, " \t\n", None, None, 3), (n + 3, "!!! 123", "en", "a", 7), (None, "the river", "en", "a", 9)]
    rows += [rows[0], rows[0], (1, "another text with a known id", "en", "b", 28), (n + 4, say(en, 20_000), "en", "c", 0), (n + 5, "x" * 3000, "en", "c", 3000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return some_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    _shared.ship(spark)
    # columns whose names the operators use themselves
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    return df.withColumns({c: F.lit("mine") for c in ("size", "key", "range", "taken", "fp", "score", "k1", "marks", "path", "h")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def text_of(rows):
    return [(r[0], r[1] or "") for r in rows]


def test_media(docs, rows, nothing):
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.described(media.stored(docs)).collect())
    want = collections.Counter()
    for i, t in text_of(rows):
        p = t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64))
        want[i, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == want and media.described(media.stored(nothing)).count() == 0
    assert media.clip_rows(media.stored(docs)).groupBy("doc_id").agg(F.min("clip")).count() == len({r[0] for r in rows})


def test_media_files():
    rng = np.random.default_rng(0)
    for data in (bytes(64), b"\xff" * 4096, rng.integers(0, 256, 5184, dtype=np.uint8).tobytes()):
        avi = media.store(data)
        frames, samples, rate = media.read_avi(avi)
        assert samples == len(data) and rate == 25 and media.features(avi)[0] == data
        assert (media._decode_any(frames[0]) == media.decode_frames(frames)[0]).all()
    dark, light = bytes(1024 * 6), b"\xc8" * 1024 * 5
    assert [c[3] for c in media.clips(media.store(dark + light))] == [6, 5]
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF....WAVE")


def test_quality(spark, nothing):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice("alpha beta gamma delta river house sun moon tree".split()) for _ in range(40)) + "."
    bad = lambda: "### ".join(rng.choice("WIN CASH NOW!!! $$$ %%%".split()) for _ in range(40))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(7, None), (None, 1)], "doc_id long, quality int")
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    space = quality.fit(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in quality.score(docs, space).collect()}
    assert len(got) == 402 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert np.mean([got[i]["predicted"] == i % 2 for i in held]) > 0.95
    # exact cosines: the votes of a plain loop
    x = np.array([quality.terms(t) for _, t in rows[:20]], np.float32)
    places = space.place(x)
    for row, s in zip(places, space.scores(x), strict=True):
        near = sorted(((float(v @ row), y) for v, y in zip(space.vectors, space.labels, strict=True)), key=lambda a: -a[0])[: quality.NEIGHBOURS]
        votes = [(max(c, 0) ** quality.POWER, y) for c, y in near]
        assert abs(s - sum(c * y for c, y in votes) / sum(c for c, _ in votes)) < 1e-3
    empty = quality.fit(nothing, labels.where("false"))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5} and quality.score(nothing, space).count() == 0


def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs, digits=1).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, budget = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        full = [s for s in left if weight[s] * level > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left.discard(s)
    target |= {s: weight[s] * level for s in left}
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and all(taken[s] == int(target[s] + 1e-9) for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2), digits=2).collect()))
    assert mixing.mix(nothing).count() == 0 and "Python" not in mixing.mix(docs)._jdf.queryExecution().toString()
    mixed = mixing.mixed_documents(docs.drop("size", "key", "range", "taken"))
    assert sum(size(r["text"]) for r in mixed.collect()) == sum(taken.values())


def test_warc(spark):
    page = "<p>" + "word " * 40 + "</p>"
    data = [(5, "http://a/é", page), (3, None, page), (9, "http://b\r\nX", page), (9, "http://b", page), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", page), (6, "u", ""), (7, "u", "ü\r\n\r\n" * 3000)]
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)).collect())
    want = collections.Counter()
    for i, _, h in data:
        b = (h or "").encode()
        copy = len(b) >= 100 and h == page and i != 3
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if copy else "response", "3" if copy else None] += 1
    assert got == want
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    head, payload = warc.parse(warc.record(1, "u", b"x\r\n\r\ny", "d", None))
    assert payload == b"x\r\n\r\ny" and head["warc-type"] == "response"


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_labels(fps):
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 3) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def test_simhash(docs, rows, nothing):
    got = collections.Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.groups(docs).collect())
    fps = [slow_fingerprint(t) for _, t in text_of(rows)]
    label = least_labels(fps)
    want = collections.Counter()
    for k, (i, _) in enumerate(text_of(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        want[i, fps[k], min(ids, default=None)] += 1
    assert got == want and simhash.groups(nothing).count() == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(label))


def test_bk_trees():
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 40, dtype=np.int64)
    flips = [np.bitwise_xor.reduce([np.int64(1) << np.int64(b) for b in rng.integers(0, 62, 3)]) for _ in range(400)]
    fp = np.unique(np.concatenate([base, rng.choice(base, 400) ^ np.array(flips)]))
    a, b = simhash.ties(np.zeros(len(fp), np.int64), fp, 3)
    at = {int(x): k for k, x in enumerate(fp)}
    label = simhash.union(len(fp), np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]), np.arange(len(fp)))
    assert label.tolist() == least_labels([int(x) & (1 << 64) - 1 for x in fp])
    for n in (10, 1 << 23, 1 << 36):  # any two within the radius agree under a mask, whatever the number of blocks
        masks = simhash.blocks(n, 3)
        for _ in range(300):
            x = int(np.bitwise_xor.reduce([np.int64(1) << np.int64(k) for k in rng.integers(0, 62, 3)]))
            assert any(x & m == 0 for m in masks)


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(docs, tokenizer_path())
    found = pieces.collect()
    used = collections.defaultdict(list)
    for r in found:
        assert 0 < r["length"] <= 2048 and len(r["ids"]) == 4 * r["length"]
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end == 2048 or end & (end - 1) == 0
    ids = collections.Counter(tuple([*tok.encode(t, add_special_tokens=False).ids, 1]) for _, t in text_of(rows))
    tokens = collections.Counter()
    for r in found:
        tokens.update(np.frombuffer(r["ids"], "<u4").tolist())
    want = collections.Counter()
    for t, n in ids.items():
        for x in t:
            want[x] += n
    assert tokens == want and packing.pack(nothing, tokenizer_path()).count() == 0
    by = collections.defaultdict(list)
    for r in found:
        if r["doc_id"] == 124:
            by[r["doc_id"]].append((r["start"], r["ids"]))
    assert np.frombuffer(b"".join(x for _, x in sorted(by[124])), "<u4").tolist() == [*tok.encode(dict(text_of(rows))[124], add_special_tokens=False).ids, 1]
    assert packing.sequences(pieces).agg(F.sum("used")).first()[0] == sum(tokens.values())


def test_fill_is_the_best_subset():
    rng = random.Random(6)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(0, 7))}
        target = rng.randint(0, 90)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        taken = packing.fill(counts, sorted(counts), target)
        assert all(n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= target)


def slow_cut(texts, length=200):
    seen = collections.Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    for b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        yield bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))


def test_suffixes(docs, rows, nothing):
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.remaining(docs).collect())
    texts = [t.encode() for _, t in text_of(rows)]
    want = collections.Counter((rows[k][0], len(texts[k]), removed, runs, kept) for k, (kept, removed, runs) in enumerate(slow_cut(texts)))
    assert got == want and sum(k[2] for k in want) > 1000
    assert suffixes.remaining(nothing).count() == 0
    left = suffixes.stripped_documents(docs)
    assert left.columns == docs.columns and left.count() == len(rows)


def test_very_common_lines(spark):
    """A line that every text has, alone and within one that goes on alike, dealt by both digits."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    line, longer = word(100), word(230)
    rows = [(i, word(rng.randint(0, 150)) + line + word(3) + line + (longer if i % 4 == 0 else "") + word(40) + "-" * (i % 300)) for i in range(400)]
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in suffixes.remaining(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    assert list(got[i] for i, _ in rows) == list(slow_cut([t.encode() for _, t in rows]))


@pytest.mark.parametrize("hot, hot_edges, group", [(64, 512, 1 << 13), (2, 1 << 30, 3), (3, 4, 5), (1 << 30, 1 << 30, 2), (1 << 30, 3, 1 << 30)])
def test_every_digit_alone(spark, hot, hot_edges, group):
    """Whichever digit rows are dealt by, the bytes that go are the same."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    lines = [word(n) for n in (120, 140, 170, 199, 230, 420)]
    rows = [(i, "".join(word(rng.randint(0, 90)) + rng.choice(lines) for _ in range(rng.randint(0, 6)))) for i in range(250)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(i, "ab" * 300) for i in range(2000, 2010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r["doc_id"], bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in suffixes.remaining(docs, hot=hot, hot_edges=hot_edges, group=group).collect())
    texts = [t.encode() for _, t in rows]
    assert got == collections.Counter((rows[k][0], *cut) for k, cut in enumerate(slow_cut(texts)))


def most_rows_made(df):
    """Of the Python operators of a plan that has run, the most rows that one has made."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name == "MapInArrow":
            found.append(node.metrics().apply("pythonNumRowsReceived").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return max(found)


@pytest.mark.parametrize("copies", [100, 2000])
def test_rows_of_large_groups(spark, copies):
    """A passage in so many texts that its edges are no longer ordered in one task does not make a row for each window."""
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = word(350)
    rows = [(i, word(250) + passage + word(250)) for i in range(copies)]
    df = suffixes.remaining(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), hot_edges=1 << 30, group=256)
    got = {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in df.collect()}
    assert list(got[i] for i, _ in rows) == list(slow_cut([t.encode() for _, t in rows]))
    assert most_rows_made(df) < 50 * copies


def test_common_digits_of_small_tasks():
    """A third digit that a task has 40 times among 1,200 edges, as all other tasks may, isn't left to one task."""
    import pyarrow as pa

    rng = random.Random(15)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = word(220)
    texts = [word(300) + (passage if i < 40 else word(220)) + word(300) for i in range(600)]
    batch = pa.RecordBatch.from_pydict({
        "k1": pa.array(range(600)),
        "k2": pa.array(range(600)),
        "row": pa.array([{"text": t} for t in texts]),
        "marks": pa.array([[(380 << 2) + suffixes.EDGE]] * 600, pa.list_(pa.int64())),
    })
    edges = pa.Table.from_batches(list(suffixes._edges(200, 64, suffixes.HOT_EDGES)(iter([batch])))).to_pylist()
    assert sum(r["kind"] == suffixes.BYTES for r in edges) >= 1100
    told = {r["key"] for r in edges if r["kind"] == suffixes.TOLD}
    assert len(told) == 2 and not any(r["key"] in told for r in edges if r["kind"] == suffixes.BYTES)


def test_windows_streamed():
    """Groups that begin in one batch and end in another, with and without word of windows dealt elsewhere."""
    import pyarrow as pa

    rng = random.Random(13)
    rows = []
    for key in range(6):
        core = bytes(rng.randrange(256) for _ in range(132))
        for i in range((1, 2, 3, 20, 40, 7)[key]):
            left, right = bytes(rng.choice(b"xy") for _ in range(3)), rng.choice((b"u" * 80, b"v" * 80))
            rows.append((key, 0, i, key, 1000, 71, left + core + right, True, suffixes.BYTES))
    rows += [(5, 0, 0, None, -1, None, None, None, suffixes.TOLD)]
    rows.sort(key=lambda r: (r[0], r[4]))
    want = None
    for most in (1 << 20, 4, 1):
        batches = [pa.RecordBatch.from_pylist([dict(zip(suffixes.EDGE_SCHEMA.names, r, strict=True)) for r in rows[k : k + 5]], suffixes.EDGE_SCHEMA) for k in range(0, len(rows), 5)]
        out = pa.Table.from_batches(list(suffixes._ordered(200, 64, most)(iter(batches)))).to_pylist()
        sent = pa.Table.from_pylist(sorted(out, key=lambda r: (r["key"], r["other"])), suffixes.EDGE_SCHEMA).to_batches(max_chunksize=7)
        spans = [(r["k1"], r["k2"], r["span"]) for b in suffixes._repeats(200)(iter(sent)) for r in b.to_pylist()]
        gone = collections.defaultdict(set)
        for k1, k2, span in spans:
            gone[k1, k2] |= set(range(span >> 32, span & 0xFFFFFFFF))
        assert any(k[1] == 5 for k in gone) and {r["k2"] for r in out if r["kind"] == suffixes.WINDOW} >= {5}
        assert want is None or {k: (min(v), max(v), len(v)) for k, v in want.items()} == {k: (min(v), max(v), len(v)) for k, v in gone.items()}
        want = dict(gone)


PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var a="</p><p>no";</script></head><body class="nav-open">
<nav><ul><li><a href=/a>Home</a><li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>A &amp; B</h1></header><p>First  <b>para</b>&nbsp;graph<br>goes on<p>Second<div class="ad">Buy</div>
<section class="comments"><p>Nice!</p></section></article><aside>Side</aside><form><label>Name</label></form><footer>(c) 2024</footer></body></html>"""


def test_page_text(spark):
    # a notice and an advert are known by coming on other pages as well
    page = lambda i: PAGE.replace("A &amp; B", f"A &amp; B{i}").replace("goes on", f"goes on {i}").replace("Second", f"Second {i}")
    rows = [(i, f"http://h/{i}", page(i)) for i in range(40)] + [(1, "http://h/1", page(1)), (200, None, None), (300, "http://h/3", ""), (400, "no url", "plain < text & more")]
    # a template that no markup names: the same line on every page of a host
    rows += [(500 + i, f"https://t.example/{i}", f"<body><div class=top><p>Our shop is great</p></div><div class=main><p>Story {i} of {i * 7}</p><p>And {i * 3} more</p></div></body>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "A & B1\nFirst para graph goes on 1\nSecond 1"
    assert got[200] == got[300] == "" and got[400] == "plain < text & more"
    assert got[507] == "Story 7 of 49\nAnd 21 more"
    assert pagetext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language(docs, rows, nothing):
    got = [r for r in language.identify(docs, language.learnable(F.col("doc_id"))).collect()]
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows if r[1] and r[2]}
    # every eleventh row has its neighbour's text, which may be in the other language
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] in lang and r["doc_id"] % 11 != 5 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"] < 120]
    assert len(held) > 20 and np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (120, 121, 122, 123)} == {"und"}
    assert language.identify(nothing, F.lit(True)).count() == 0
    kept = language.identified_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    # bundling is linear: a prototype is the sum of its texts' vectors
    v = language.Vectors()
    whole = sum(language.bundle(v, t) for t in ("abc dé", "xyz"))
    grams, n = language.counted(np.concatenate([language.trigrams("abc dé"), language.trigrams("xyz")]))
    assert np.allclose(whole, n @ v.of(grams).astype(int))


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[50:90] = x[50]
    data = [(i, x[i].tolist()) for i in range(700)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0]), (None, x[0].tolist()), (20, x[20].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("id", F.lit("mine")).withColumn("v", F.lit(1))
    found = neighbours.neighbours(df, F.col("id") % 20 == 0, shard=300).collect()
    got = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 700, 20))
    y, hits = x.astype(np.float64), []
    for i, near in got.items():
        s = y @ y[i]
        best = sorted((j for j in range(700) if j != i), key=lambda j: (-s[j], j))[:20]
        hits.append(len({j for j, _ in near} & set(best)) / 20)
        assert len(near) == 20 and all(abs(v - s[j]) < 1e-9 for j, v in near)
        assert [(-round(v, 9), j) for j, v in near] == sorted((-round(v, 9), j) for j, v in near)
    assert np.mean(hits) >= 0.9
    assert neighbours.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["rank"]) for r in neighbours.neighbours(few, F.col("id") % 20 == 0).orderBy("rank").collect()] == [(2, 1), (1, 2)]


@pytest.mark.parametrize("norms", ["unit", "log-normal", "one outlier"])
def test_recall_at_any_length(spark, norms):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(8192, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= {"unit": np.ones(8192), "log-normal": np.exp(1.5 * rng.normal(size=8192)), "one outlier": np.r_[1e4, np.ones(8191)]}[norms][:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(dict)
    for r in neighbours.neighbours(df, F.col("id") % 20 == 0).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    hits = []
    for i in range(0, 8192, 20):
        s = x @ x[i]
        s[i] = -np.inf
        best = np.argsort(-s, kind="stable")[:20]
        hits.append(len(set(best.tolist()) & set(got[i])) / 20)
        assert len(got[i]) == 20 and all(abs(v - s[j]) <= 1e-9 * abs(s[j]) for j, v in got[i].items())
    assert np.mean(hits) >= 0.95


def test_exact_neighbours_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BYTES", 8 * 8 * 10)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 8)) * np.exp(rng.normal(size=300))[:, None]
    # an id with several vectors asks with all, is found once at its best and never by itself
    ids = [k if k < 250 else k - 250 for k in range(300)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("band", "shard", "score", "block", "h")})
    want = set()
    for i in range(0, 250, 20):
        best = {}
        for a in np.flatnonzero(np.array(ids) == i):
            for j, s in zip(ids, x @ x[a], strict=True):
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float(s))
        want |= {(i, k + 1, j) for k, j in enumerate(sorted(best, key=lambda j: (-best[j], j))[:20])}
    for exact in (True, False):
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.neighbours(df, F.col("id") % 20 == 0, shard=100, exact=exact).collect()} == want
    assert neighbours.recall(df, F.col("id") % 20 == 0, shard=100) == 1.0
