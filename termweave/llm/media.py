"""Media columns: AVI motion-JPEG of 8-bit grey frames, stored without loss, parsed back, and cut into shots.

Writing: bytes become samples of SIDE x SIDE frames; each frame is a JPEG of the lossless process (SOF3, predictor 1,
precision 8), so every decoder gives the very samples. Its Huffman table gives category s a code of 9 - s bits; with
the s bits that follow, every sample takes 9, and a whole batch of frames is coded and decoded as arrays. The frames
go into a RIFF AVI: header lists, a `movi` list with a chunk a frame, and the `idx1` index. The count of samples, which
need not fill the last frame, is in an INFO list.

Reading: frames are found through `idx1` alone, each is decoded from its own tables (intra frames: none needs another),
and the exact count of samples is kept. Frames of the baseline process (SOF0), which other writers store, are decoded as
well: grey ones, or the luma of those in colour, with the standard's Huffman tables where a frame has none.

Shots: a frame starts a new one if the histogram of its samples differs from that of the frame before by more than
the mean of the differences around it plus SPREAD standard deviations, and by FLOOR at least. Clips are the runs
between, with start and end in seconds.

Defined results: null and empty texts are one block of 64 zero bytes; equal texts give equal values; rows that repeat
an id are rows of their own; an empty table gives an empty result. Only the named columns are looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


SIDE, RATE = 32, 25
FRAME = SIDE * SIDE
BINS, AROUND, SPREAD, FLOOR = 16, 8, 1.0, 0.25
#: Frames coded at once, and bytes of texts written at once (one text at least).
BATCH, AT_ONCE = 2048, 1 << 22
BLOCK = 64


def padded(text: str | None) -> bytes:
    """UTF-8, and zero bytes up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


# ---- frames -----------------------------------------------------------------------------------------------------

#: Code lengths 1 to 8 for the categories 8 to 1, and 9 for 0: with its extra bits each category takes 9.
_HUFFMAN = (b"\x01" * 9 + b"\x00" * 7, bytes(range(8, -1, -1)))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Difference (-255 .. 255, plus 255) -> its 9 bits, and the way back."""
    code = np.zeros(511, np.uint16)
    back = np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = (1 << 8 - s) - 1 << 1 if s else 0b111111110
        bits = d if d > 0 else d + (1 << s) - 1
        code[d + 255] = (prefix << s | bits) if s else prefix
        back[code[d + 255]] = d
    return code, back


_CODE, _BACK = _tables()


def jpeg_header(width: int, height: int) -> bytes:
    counts, values = _HUFFMAN
    return (
        b"\xff\xd8"
        + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00"
        + b"\xff\xc4" + struct.pack(">HB", 19 + len(values), 0) + counts + values
        + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00" + b"\x01\x00\x00"
    )


_HEADER = jpeg_header(SIDE, SIDE)


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """(n, SIDE, SIDE) samples -> JPEG files."""
    out = []
    for k in range(0, len(frames), BATCH):
        x = frames[k : k + BATCH].astype(np.int16)
        d = np.empty_like(x)
        d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
        d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
        d[:, 0, 0] = x[:, 0, 0] - 128
        codes = _CODE[d + 255].reshape(len(x), -1, 8)
        bits = np.empty((len(x), FRAME // 8, 9), np.uint8)
        for i in range(8):  # byte i has the last bits of code i - 1 and the first of code i
            high = codes[:, :, i] >> (i + 1)
            bits[:, :, i] = high if not i else high | (codes[:, :, i - 1] << (8 - i)) & 0xFF
        bits[:, :, 8] = codes[:, :, 7] & 0xFF
        for row in bits.reshape(len(x), -1):
            out.append(_HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return out


def _segments(jpeg: bytes) -> Iterator[tuple[int, int, int]]:
    """Marker, and where its payload begins and ends, up to the scan."""
    at = 2
    while at + 4 <= len(jpeg):
        if jpeg[at] != 0xFF:
            raise ValueError("no JPEG marker where one should be")
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        yield marker, at + 4, at + 2 + size
        at += 2 + size
        if marker == 0xDA:
            return


#: The order of a block's coefficients, and the Huffman tables of frames that bring none (counts of the
#: lengths 1 to 16, values; direct and alternating coefficients of the first and the second class).
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
_RANGES = lambda *ends: [v for a, b in ends for v in range(a, b + 1)]
STANDARD = {
    0x00: ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))),
    0x01: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12))),
    0x10: (
        [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
        [*bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a"), *_RANGES((0x16, 0x1A), (0x25, 0x2A), (0x34, 0x3A), *((k + 3, k + 10) for k in range(0x40, 0x90, 16)))]
        + _RANGES(*((k + 2, k + 10) for k in range(0x90, 0xE0, 16)), (0xE1, 0xEA), (0xF1, 0xFA)),
    ),
    0x11: (
        [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
        [*bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"), *_RANGES((0x17, 0x1A), (0x26, 0x2A), (0x35, 0x3A), *((k + 3, k + 10) for k in range(0x40, 0x80, 16)))]
        + _RANGES(*((k + 2, k + 10) for k in range(0x80, 0x100, 16))),
    ),
}
_WAVES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _codes(counts, values) -> list[tuple[int, int]]:
    """The next 16 bits -> length and value of the code that they begin with."""
    table, code, at = [(0, 0)] * (1 << 16), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << 16 - length
            table[first : first + (1 << 16 - length)] = [(length, values[at])] * (1 << 16 - length)
            code, at = code + 1, at + 1
        code <<= 1
    return table


def decode_baseline(jpeg: bytes) -> np.ndarray:
    """One frame of the baseline process: its samples, or its luma."""
    steps, huffman = {}, {}
    every = height = width = 0
    parts, scan, scanned = [], 0, []
    for marker, a, b in _segments(jpeg):
        if marker == 0xDB:
            while a < b:
                wide = jpeg[a] >> 4
                size = 128 if wide else 64
                steps[jpeg[a] & 15] = np.frombuffer(jpeg[a + 1 : a + 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                a += 1 + size
        elif marker == 0xC4:
            while a < b:
                counts = list(jpeg[a + 1 : a + 17])
                huffman[jpeg[a]] = _codes(counts, list(jpeg[a + 17 : a + 17 + sum(counts)]))
                a += 17 + sum(counts)
        elif marker in (0xC0, 0xC1):
            precision, height, width, n = struct.unpack(">BHHB", jpeg[a : a + 6])
            if precision != 8:
                raise ValueError("only samples of 8 bits are read")
            parts = [(jpeg[k], jpeg[k + 1] >> 4, jpeg[k + 1] & 15, jpeg[k + 2]) for k in range(a + 6, a + 6 + 3 * n, 3)]
        elif marker == 0xDD:
            every = int.from_bytes(jpeg[a : a + 2], "big")
        elif marker == 0xDA:
            scanned, scan = [(jpeg[k], jpeg[k + 1] >> 4, jpeg[k + 1] & 15) for k in range(a + 1, a + 1 + 2 * jpeg[a], 2)], b
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not a baseline frame")
    if not parts or len(scanned) != len(parts):
        raise ValueError("a frame is one scan of all its components here")
    tables = {k: huffman.get(k) or _codes(*STANDARD[k]) for _, d, c in scanned for k in (d, 16 + c)}
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    luma = np.zeros((down * parts[0][2] * 8, across * parts[0][1] * 8))
    order = np.array(ZIGZAG)
    before, unit, words, bit, ends = [0] * len(parts), 0, [], 0, 0
    pieces = iter(re.split(rb"\xff[\xd0-\xd7]", jpeg[scan : jpeg.rindex(b"\xff\xd9")]))
    for row in range(down):
        for column in range(across):
            if unit % every == 0 if every else not unit:
                data = np.frombuffer(next(pieces).replace(b"\xff\x00", b"\xff") + b"\xff" * 8, np.uint8).astype(np.int64)
                words, bit, before = (data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]).tolist(), 0, [0] * len(parts)
                ends = 8 * (len(data) - 7)
            unit += 1
            for k, ((_, h, v, quantizer), (_, direct, alternating)) in enumerate(zip(parts, scanned, strict=True)):
                for block in range(h * v):
                    values, at = [0] * 64, 0
                    while at < 64:
                        if bit > ends:
                            raise ValueError("a frame ends within its scan")
                        length, symbol = tables[16 + alternating if at else direct][words[bit >> 3] >> 16 - (bit & 7) & 0xFFFF]
                        if not length:
                            raise ValueError("no code of the frame's table")
                        bit += length
                        size = symbol & 15
                        if at:
                            if not size:
                                if symbol != 0xF0:
                                    break
                                at += 16
                                continue
                            at += symbol >> 4
                        extra = (words[bit >> 3] >> 32 - (bit & 7) - size & (1 << size) - 1) if size else 0
                        bit += size
                        values[min(at, 63)] = extra if not size or extra >> size - 1 else extra - (1 << size) + 1
                        at += 1
                    values[0] += before[k]
                    before[k] = values[0]
                    if not k:
                        grid = np.zeros(64)
                        grid[order] = np.array(values) * steps[quantizer]
                        y, x = (row * v + block // h) * 8, (column * h + block % h) * 8
                        luma[y : y + 8, x : x + 8] = _WAVES.T @ grid.reshape(8, 8) @ _WAVES
    return np.clip(np.rint(luma[:height, :width] + 128), 0, 255).astype(np.uint8)


def _decode_any(jpeg: bytes) -> np.ndarray:
    """One frame: a baseline one, or a lossless grey one with any Huffman table, bit by bit, predictor 1 only."""
    if any(marker in (0xC0, 0xC1) for marker, _, _ in _segments(jpeg)):
        return decode_baseline(jpeg)
    lookup: dict[tuple[int, int], int] = {}
    width = height = start = 0
    for marker, a, b in _segments(jpeg):
        if marker == 0xC3:
            precision, height, width, parts = struct.unpack(">BHHB", jpeg[a : a + 6])
            if precision != 8 or parts != 1:
                raise ValueError("only grey frames of 8-bit samples are stored here")
        elif marker == 0xC4:
            code, at = 0, a + 17
            for length in range(1, 17):
                for _ in range(jpeg[a + length]):
                    lookup[length, code] = jpeg[at]
                    code, at = code + 1, at + 1
                code <<= 1
        elif marker == 0xDA:
            if jpeg[b - 3] != 1:
                raise ValueError("only predictor 1 is stored here")
            start = b
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a lossless frame")
    data = jpeg[start : jpeg.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    out, at = np.zeros((height, width), np.int64), 0
    for y in range(height):
        for x in range(width):
            code = length = 0
            while (length, code) not in lookup or not length:
                code, length, at = code << 1 | bits[at], length + 1, at + 1
            s = lookup[length, code]
            extra = 0
            for _ in range(s):
                extra, at = extra << 1 | bits[at], at + 1
            d = extra if not s or extra >> s - 1 else extra - (1 << s) + 1
            near = out[y, x - 1] if x else out[y - 1, 0] if y else 128
            out[y, x] = near + d & 0xFFFF
    return out.astype(np.uint8)


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """JPEG files -> (n, height, width) samples. Frames with this module's own table are decoded all at once."""
    if any(not j.startswith(_HEADER) for j in jpegs):
        return np.stack([_decode_any(j) for j in jpegs])
    parts = []
    for k in range(0, len(jpegs), BATCH):
        scans = [j[len(_HEADER) : -2].replace(b"\xff\x00", b"\xff") for j in jpegs[k : k + BATCH]]
        bits = np.frombuffer(b"".join(scans), np.uint8).reshape(len(scans), FRAME // 8, 9).astype(np.uint16)
        codes = np.empty((len(scans), FRAME // 8, 8), np.uint16)
        for i in range(8):
            codes[:, :, i] = (bits[:, :, i] << (i + 1) | bits[:, :, i + 1] >> (7 - i)) & 0x1FF
        d = _BACK[codes.reshape(len(scans), SIDE, SIDE)]
        d[:, 0, 0] += 128
        d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
        parts.append(np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8))
    return np.concatenate(parts) if parts else np.zeros((0, SIDE, SIDE), np.uint8)


# ---- the container ----------------------------------------------------------------------------------------------


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\x00" * (len(data) & 1)


def _list(name: bytes, *parts: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(parts))


def write_avi(jpegs: list[bytes], samples: int) -> bytes:
    most = max(map(len, jpegs), default=0)
    head = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(jpegs), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(jpegs), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    chunks = [_chunk(b"00dc", j) for j in jpegs]
    index, at = [], 4
    for chunk, jpeg in zip(chunks, jpegs, strict=True):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        at += len(chunk)
    if at > 0xF0000000:
        raise ValueError("a RIFF AVI holds less than 4 GiB")
    parts = [
        _list(b"hdrl", _chunk(b"avih", head), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", picture))),
        _list(b"INFO", _chunk(b"ICMT", b"samples=%d\x00" % samples)),
        _list(b"movi", *chunks),
        _chunk(b"idx1", b"".join(index)),
    ]
    return _chunk(b"RIFF", b"AVI " + b"".join(parts))


def read_avi(data: bytes) -> tuple[list[bytes], int | None, float]:
    """The frames (in the order of idx1), the count of samples if it is noted, and the frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI")
    movi, index, samples, rate = None, None, None, float(RATE)

    def walk(at: int, end: int) -> None:
        nonlocal movi, index, samples, rate
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST" and data[body : body + 4] == b"movi":
                movi = body  # offsets in idx1 count from this list's name
            elif name == b"LIST":
                walk(body + 4, body + size)
            elif name == b"idx1":
                index = data[body : body + size]
            elif name == b"avih":
                rate = 1e6 / (int.from_bytes(data[body : body + 4], "little") or 40_000)
            elif name == b"ICMT" and data[body : body + 8] == b"samples=":
                samples = int(data[body + 8 : body + size].rstrip(b"\x00"))
            at = body + size + (size & 1)

    walk(12, min(len(data), 8 + int.from_bytes(data[4:8], "little")))
    if movi is None or index is None:
        raise ValueError("an AVI without movi list or idx1 index")
    frames, base = [], None
    for name, _, at, size in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            if base is None:  # some writers count from the file's begin
                base = movi if data[movi + at : movi + at + 4] == name else 0
            if data[base + at : base + at + 4] != name:
                raise ValueError("idx1 points past a frame")
            frames.append(data[base + at + 8 : base + at + 8 + size])
    return frames, samples, rate


def store(payload: bytes) -> bytes:
    """Bytes -> AVI, each byte a sample."""
    whole = np.zeros(-(-len(payload) // FRAME) * FRAME, np.uint8)
    whole[: len(payload)] = np.frombuffer(payload, np.uint8)
    return write_avi(encode_frames(whole.reshape(-1, SIDE, SIDE)), len(payload))


# ---- shots ------------------------------------------------------------------------------------------------------


def histograms(frames: np.ndarray, samples: int | None = None) -> np.ndarray:
    """Shares of samples in BINS bins, a row a frame; what fills up the last frame doesn't count."""
    flat = (frames.reshape(-1)[:samples] >> 4).astype(np.int64)
    size = frames[0].size if len(frames) else 1
    flat += np.arange(len(flat)) // size * BINS
    counts = np.bincount(flat, minlength=len(frames) * BINS).reshape(-1, BINS)
    return counts / np.maximum(1, counts.sum(axis=1, keepdims=True))


def shots(frames: np.ndarray, samples: int | None = None) -> list[int]:
    """The frames with which shots begin; 0 first."""
    if not len(frames):
        return []
    h = histograms(frames, samples)
    d = np.abs(h[1:] - h[:-1]).sum(axis=1) / 2
    starts = [0]
    for k in range(len(d)):
        near = np.concatenate([d[max(0, k - AROUND) : k], d[k + 1 : k + 1 + AROUND]])
        if d[k] > FLOOR and d[k] > (near.mean() + SPREAD * near.std() if len(near) else 0):
            starts.append(k + 1)
    return starts


def clips(data: bytes) -> list[tuple[int, float, float, int]]:
    """Of a stored file: (clip, start second, end second, frames)."""
    jpegs, samples, rate = read_avi(data)
    starts = shots(decode_frames(jpegs), samples)
    return [(k, a / rate, b / rate, b - a) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(jpegs)], strict=True))]


def features(data: bytes) -> tuple[bytes, str]:
    """What is read back from a stored file: the payload, and a line that describes its frames and shots."""
    jpegs, samples, rate = read_avi(data)
    frames = decode_frames(jpegs)
    payload = frames.tobytes()[:samples]
    starts = shots(frames, samples)
    ends = [*starts[1:], len(frames)]
    mean = np.frombuffer(payload, np.uint8).sum(dtype=np.int64) * 1000 // max(1, len(payload))
    spans = ",".join(f"{a / rate:.2f}-{b / rate:.2f}" for a, b in zip(starts, ends, strict=True))
    return payload, f"frames={len(frames)};mean={mean // 1000}.{mean % 1000:03d};shots={len(starts)};clips={spans}"


# ---- columns ----------------------------------------------------------------------------------------------------


def taken(sizes: list[int], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to `most` at most, each of one row at least."""
    start, total = 0, 0
    for k, size in enumerate(sizes):
        total += size + FRAME
        if k > start and total > most:
            yield start, k
            start, total = k, size + FRAME
    if start < len(sizes):
        yield start, len(sizes)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary, an AVI file) for every whole text of docs."""
    kind = docs.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [n or 0 for n in pc.binary_length(batch.column(1)).to_pylist()]
            for k, end in taken(sizes):
                part = batch.slice(k, end - k)
                payloads = [padded(t) for t in part.column(1).to_pylist()]
                # the frames of many texts at once
                counts = [-(-len(p) // FRAME) for p in payloads]
                whole = np.zeros(sum(counts) * FRAME, np.uint8)
                at = 0
                for p, n in zip(payloads, counts, strict=True):
                    whole[at : at + len(p)] = np.frombuffer(p, np.uint8)
                    at += n * FRAME
                jpegs, at, files = encode_frames(whole.reshape(-1, SIDE, SIDE)), 0, []
                for p, n in zip(payloads, counts, strict=True):
                    files.append(write_avi(jpegs[at : at + n], len(p)))
                    at += n
                sizes = [0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    return docs.select("doc_id", "text").mapInArrow(run, StructType([kind, StructField("n_bytes", LongType()), StructField("media", BinaryType())]))


def described(media: DataFrame) -> DataFrame:
    """media's rows, each file parsed and decoded: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(2):
                data = x.as_py()
                payload, line = features(data)
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), line))
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", *names])

    schema = media.select("doc_id", "n_bytes").schema
    for n, k in zip(names, kinds, strict=True):
        schema = schema.add(n, "string" if k == pa.string() else "long")
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def clip_rows(media: DataFrame) -> DataFrame:
    """A row a clip: doc_id, clip, start_s, end_s, frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for k, x in enumerate(batch.column(1)):
                new = clips(x.as_py())
                at += [k] * len(new)
                found += new
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "clip", "start_s", "end_s", "frames"])

    schema = media.select("doc_id").schema.add("clip", "integer").add("start_s", "double").add("end_s", "double").add("frames", "integer")
    return media.select("doc_id", "media").mapInArrow(run, schema)
