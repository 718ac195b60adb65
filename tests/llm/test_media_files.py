"""Motion-JPEG of other writers, hashes and shots against brute force, through the query."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from termweave.llm import _shared, media
from termweave.llm.queries import QUERIES
from test_operators import DOCS, some_docs


class Bits:
    def __init__(self):
        self.text = ""

    def add(self, value, length):
        self.text += format(value, f"0{length}b") if length else ""

    def data(self):
        padded = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(padded[k : k + 8], 2) for k in range(0, len(padded), 8)).replace(b"\xff", b"\xff\x00")


def codes(table):
    counts, values = media.STANDARD[table]
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def zigzag():
    """The order of coefficients, walked."""
    out, x, y, up = [], 0, 0, True
    for _ in range(64):
        out.append(8 * y + x)
        if up:
            x, y, up = (x, y + 1, False) if x == 7 else (x + 1, 0, False) if y == 0 else (x + 1, y - 1, True)
        else:
            x, y, up = (x + 1, y, True) if y == 7 else (0, y + 1, True) if x == 0 else (x - 1, y + 1, False)
    return out


def baseline(planes, factors, step=2, every=0, own_tables=False):
    """A frame of the baseline process; planes: (rows, columns), each a multiple of its factor times 8."""
    waves = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.5 / np.sqrt(2)) for x in range(8)] for u in range(8)])
    out, before, wide, high = [Bits()], [0] * len(planes), factors[0][0], factors[0][1]
    height, width = planes[0].shape
    tables, order, unit = {k: codes(k) for k in media.STANDARD}, zigzag(), 0
    for row in range(height // (8 * high)):
        for column in range(width // (8 * wide)):
            if every and unit and unit % every == 0:
                out.append(Bits())
                before = [0] * len(planes)
            unit += 1
            for k, (plane, (h, v)) in enumerate(zip(planes, factors, strict=True)):
                for b in range(h * v):
                    y, x = (row * v + b // h) * 8, (column * h + b % h) * 8
                    block = np.rint(waves @ (plane[y : y + 8, x : x + 8] - 128.0) @ waves.T / step).astype(int).ravel()[order]
                    values, run = [int(block[0]) - before[k], *map(int, block[1:])], 0
                    before[k] = int(block[0])
                    for at, value in enumerate(values):
                        size = abs(value).bit_length()
                        bits = value if value > 0 else value + (1 << size) - 1
                        if at == 0:
                            out[-1].add(*tables[1 if k else 0][size])
                            out[-1].add(bits, size)
                        elif value:
                            while run > 15:
                                out[-1].add(*tables[0x11 if k else 0x10][0xF0])
                                run -= 16
                            out[-1].add(*tables[0x11 if k else 0x10][run << 4 | size])
                            out[-1].add(bits, size)
                            run = 0
                        else:
                            run += 1
                    if run:
                        out[-1].add(*tables[0x11 if k else 0x10][0])
    part = lambda marker, data: b"\xff" + bytes([marker]) + struct.pack(">H", len(data) + 2) + data
    head = b"\xff\xd8" + part(0xDB, b"\x00" + bytes([step]) * 64)
    head += part(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors)))
    if own_tables:
        head += b"".join(part(0xC4, bytes([k, *c, *v])) for k, (c, v) in media.STANDARD.items())
    if every:
        head += part(0xDD, struct.pack(">H", every))
    head += part(0xDA, bytes([len(planes), *[x for k in range(len(planes)) for x in (k + 1, 0x11 if k else 0)], 0, 63, 0]))
    scan = b"".join(b.data() + (b"\xff" + bytes([0xD0 + k % 8]) if k < len(out) - 1 else b"") for k, b in enumerate(out))
    return head + scan + b"\xff\xd9"


def test_order_of_coefficients():
    assert media.ZIGZAG == zigzag()
    for table, (counts, values) in media.STANDARD.items():
        want = {r << 4 | s for r in range(16) for s in range(1, 11)} | {0, 0xF0} if table >= 0x10 else set(range(12))
        assert set(values) == want and len(values) == sum(counts) == len(want)


@pytest.mark.parametrize("factors", [[(1, 1)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("every, own_tables", [(0, False), (3, True)])
def test_baseline_frames(factors, every, own_tables):
    rng = np.random.default_rng(2)
    smooth = np.add.outer(np.arange(48) * 3, np.arange(64) * 1.5) % 256
    planes = [np.clip(smooth + rng.normal(0, 25, smooth.shape), 0, 255)]
    planes += [np.clip(rng.normal(128, 30, (48 * v // factors[0][1], 64 * h // factors[0][0])), 0, 255) for h, v in factors[1:]]
    got = media.decode_frames([baseline(planes, factors, every=every, own_tables=own_tables)])[0]
    assert got.shape == (48, 64) and np.abs(got - planes[0]).max() <= 8 and np.abs(got - planes[0]).mean() < 1


def test_frames_that_are_none():
    frame = baseline([np.full((8, 8), 90.0)], [(1, 1)])
    for bad in (frame.replace(b"\xff\xc0", b"\xff\xc2"), frame[:-8] + b"\xff\xd9", b"\x00" * 20):
        with pytest.raises((ValueError, StopIteration, IndexError)):
            media.decode_frames([bad])


def test_offsets_from_the_begin_of_the_file():
    frames = [baseline([np.full((8, 8), float(v))], [(1, 1)]) for v in (40, 41, 200, 201, 199)]
    avi = media.write_avi(frames, 5 * 64)
    movi = avi.index(b"movi")
    at = avi.index(b"idx1") + 8
    absolute = bytearray(avi)
    for k in range(len(frames)):
        place = at + 16 * k + 8
        absolute[place : place + 4] = struct.pack("<I", struct.unpack("<I", avi[place : place + 4])[0] + movi)
    assert media.read_avi(bytes(absolute))[0] == media.read_avi(avi)[0] == frames
    assert [(a, b) for _, a, b, _ in media.clips(bytes(absolute))] == [(0.0, 0.08), (0.08, 0.2)]


def test_rows_written_at_once():
    assert list(media.taken([])) == [] and list(media.taken([10**9, 5, 5])) == [(0, 1), (1, 3)]
    found = list(media.taken([100_000] * 200))
    assert found[0][0] == 0 and found[-1][1] == 200 and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))


def slow_shots(frames, samples):
    """By the definition, a difference after another."""
    counts = []
    for k, f in enumerate(frames):
        values = f.ravel()[: max(0, samples - k * f.size)]
        counts.append(np.bincount(values // 16, minlength=16) / max(1, len(values)))
    d = [float(np.abs(b - a).sum() / 2) for a, b in zip(counts, counts[1:], strict=False)]
    starts = [0]
    for k, x in enumerate(d):
        near = d[max(0, k - 8) : k] + d[k + 1 : k + 9]
        if x > 0.25 and x > (np.mean(near) + np.std(near) if near else 0):
            starts.append(k + 1)
    return starts


def test_query_against_brute_force(spark, tmp_path):
    _shared.ship(spark)
    rows = some_docs(60, 8)
    spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("media", "feature", "n_bytes")}).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {}
    for r in QUERIES["op1_media"](spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, text, *_ in rows:
        data = (text or "").encode()
        whole = data + bytes(-len(data) % 64 or (0 if data else 64))
        avi = media.store(whole)
        frames = np.frombuffer(whole + bytes(-len(whole) % 1024), np.uint8).reshape(-1, 32, 32)
        starts = slow_shots(frames, len(whole))
        spans = ",".join(f"{a / 25:.2f}-{b / 25:.2f}" for a, b in zip(starts, [*starts[1:], len(frames)], strict=True))
        mean = sum(whole) * 1000 // len(whole)
        line = f"frames={len(frames)};mean={mean // 1000}.{mean % 1000:03d};shots={len(starts)};clips={spans}"
        want = (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), line)
        assert want in [tuple(r)[1:] for r in got[i]]
    clips = media.clip_rows(media.stored(spark.read.parquet(str(tmp_path / "documents.parquet"))))
    assert clips.groupBy("doc_id").agg(F.count("clip").alias("n")).count() == len(got)
