"""Removing repeated passages: suffixes ordered by a radix sort that goes no deeper than the threshold.

A window is the first `length` bytes of a suffix; the windows that come twice anywhere are those in the groups of
equal suffixes after most-significant-digit passes over `length` bytes. Only suffixes that still share a group go on
to the next pass:

1. The first digit is a block of BLOCK bytes. It stands, for every window alike, at the block of least hash in it
   (of equals the last), so a block stands for all windows around it, two windows that are equal have the same block
   at the same place in them, and about one block in 69 positions is dealt to its group. Blocks alone in their group
   end here: none of their windows comes twice.
2. The second digit is all bytes of a block's windows. If these come twice, all its windows do.
3. Of the others in a group of several - the edges of repeated passages - the third digit is the bytes before or the
   bytes after the block, one of which lies whole in every window; with these equal, the windows themselves are
   ordered, byte offset by byte offset, and compared byte by byte.
4. A group of more than GROUP edges is not ordered in one task. The fourth digit is what WIDE windows side by side have
   in common: most that hold bytes beside a repeated passage end here, WIDE by WIDE. Groups are ordered as before.
5. Of groups still larger the windows are the last digit, dealt one by one: WIDE rows an edge at each end of a passage.

What comes twice in one task is settled there, and one row stands for it elsewhere, so no group has more rows than
there are tasks for the same bytes. A block that has HOT different surroundings in a task is dealt by both digits, and
a third or fourth digit that HOT_EDGES edges of a task share by the next one, so that a line that every document has
spreads over all tasks; one witness goes where the others go, so that they count as repeated, or go on as well. At worst
a block is then an edge that might have been whole, which the next digits settle. All groups are streams: a task holds
GROUP edges at most, whatever their number.

Equality in passes 1 and 2 is that of 128 bits - a rolling hash of the block and XXH3 of all bytes - and in pass 5 of the
window's 128-bit XXH3. The text moves twice to the same partitions, once for the edges and once to be cut, by one and
the same exchange.

Defined results: null is an empty text; texts shorter than a window keep all bytes; in equal texts of a window or
more every byte goes; rows that repeat an id are rows of their own. An empty table gives an empty result. Columns
besides the named ones are passed through or left out whole, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from . import _shared

LENGTH = 200
BLOCK = 64
#: Edges ordered at once: whole groups are taken until there are so many. A larger group goes on to the next digit.
GROUP = 1 << 13
#: Different surroundings of one block, and edges of one third digit, from which a task deals them by the next digit.
HOT, HOT_EDGES = 64, 16
#: Of a task's edges one in so many must share a third digit, too: the next one is several rows an edge.
SPARSE = 200
#: Windows side by side that have a fourth digit, and how many times as many must share one, as windows are more rows still.
WIDE, FEWER = 8, 4
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** 0.. and its inverses, modulo 2**64."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, pow(int(_BASE), -1, 1 << 64), np.uint64)
        down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def scrambled(h: np.ndarray) -> np.ndarray:
    """Mixes all bits into all (the finalizer of the 64-bit Murmur hash)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _bytes() -> np.ndarray:
    if -1 not in _powers:
        table = scrambled(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _powers[-1] = (table, table)
    return _powers[-1][0]


def _least(h: np.ndarray, wide: int, pick, worst: int) -> np.ndarray:
    """The least (or, by `pick`, greatest) of every run of `wide` values: running extremes forwards and backwards in blocks."""
    n = len(h)
    padded = np.full(-(-n // wide) * wide, worst, np.uint64)
    padded[:n] = h
    rows = padded.reshape(-1, wide)
    ahead = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - wide + 1], ahead[wide - 1 : n])


def chosen(h: np.ndarray, wide: int) -> np.ndarray:
    """Positions that hold the least of some run of `wide` consecutive hashes, ascending. Which of a run's positions
    are chosen depends on its content alone."""
    least = _least(h, wide, np.minimum, (1 << 64) - 1)
    # of all runs over a position, the greatest of their minima is its own hash if it is a minimum at all
    around = np.concatenate([np.zeros(wide - 1, np.uint64), least, np.zeros(wide - 1, np.uint64)])
    return np.flatnonzero(_least(around, wide, np.maximum, 0) == h)


def digits(data: np.ndarray, length: int = LENGTH, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: the chosen positions, the hash of the block at each, and that of all bytes of the windows that it stands for."""
    n, reach = len(data), length - block
    if n < length:
        return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_bytes()[data] * up[:n], out=sums[1:])
    h = scrambled((sums[block:] - sums[:-block]) * down[: n - block + 1])
    at = chosen(h, reach + 1)
    low, high = np.maximum(at - reach, 0), np.minimum(at + length, n)
    raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_64_intdigest
    # seeded with the block's place in its bytes
    around = [digest(raw[a:b], c) for a, b, c in zip(low.tolist(), high.tolist(), (at - low).tolist(), strict=True)]
    return at, h[at], np.array(around, np.uint64)


def byte_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text, without copies; none for null."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield data[at[k] : at[k + 1]] if valid[k] else data[:0]


#: Of a block's row: it is dealt by both digits; it stands for several in its task; it says that others are elsewhere; settled.
BOTH, MULTI, WITNESS, DONE = 1, 2, 4, 8
# What becomes of a block: all its windows repeat; some may; all repeat, and it shows those who may what to look for.
WHOLE, EDGE, SHOWN = 0, 1, 2
#: Blocks that a task takes at once.
TAKEN = 200_000


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: is each row the first of its run of equals, and the number of its run."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first, np.cumsum(first) - 1


def _blocks(length: int, block: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        n = 0

        def out() -> pa.RecordBatch:
            h1, h2, k1, kp = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            order = np.lexsort((h2, h1))
            h1, h2, k1, kp = h1[order], h2[order], k1[order], kp[order]
            first, group = runs(h1, h2)
            flag = np.where(first, np.where(np.bincount(group)[group] > 1, MULTI, 0), DONE)
            stands = np.flatnonzero(first)
            one, surroundings = runs(h1[stands])
            many = np.bincount(surroundings) >= hot
            flag[stands] |= np.where(many[surroundings], BOTH, 0)
            told = h1[stands][one][many]
            none = np.zeros(len(told), np.int64)
            columns = [np.concatenate(x) for x in ((h1, told), (h2, np.full(len(told), -(1 << 63))), (k1, none), (kp, none), (flag, none + WITNESS))]
            return pa.RecordBatch.from_arrays([*[pa.array(x) for x in columns[:4]], pa.array(columns[4], pa.int32())], ["h1", "h2", "k1", "kp", "flag"])

        for batch in batches:
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.int64)
            for k, data in enumerate(byte_rows(batch.column(0))):
                at, h1, h2 = digits(data, length, block)
                if len(at):
                    found.append((h1.view(np.int64), h2.view(np.int64), np.full(len(at), k1[k]), (k2[k] << 32) + at))
                    n += len(at)
                if n > TAKEN:
                    yield out()
                    n = 0
        if n:
            yield out()

    return run


class Neighbours:
    """Sorted rows in batches: what each has in common with the row before and the row after. Holds one row."""

    def __init__(self, keys: int):
        self.keys, self.held, self.before = keys, None, [False] * keys

    def of(self, rows: list[np.ndarray], final: bool = False) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """The rows that are decided, and for 1, 2, .. leading keys: are they those of the row before, and of the row after."""
        rows = [np.concatenate([h, r]) for h, r in zip(self.held, rows, strict=True)] if self.held else rows
        n = len(rows[0])
        if not n:
            return rows, [np.zeros(0, bool)] * self.keys, [np.zeros(0, bool)] * self.keys
        end, like, same = n if final else n - 1, [], np.ones(n - 1, bool)
        for k, before in zip(rows[: self.keys], self.before, strict=True):
            same = same & (k[1:] == k[:-1])
            like.append(np.concatenate([[before], same, [False]]))
        self.held, self.before = [r[end:] for r in rows], [bool(x[end]) for x in like]
        return [r[:end] for r in rows], [x[:end] for x in like], [x[1 : end + 1] for x in like]


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settled blocks, and the others in order of (h1, h2) -> those in a group of several, with what becomes of them."""
    near = Neighbours(2)

    def marks(k1: np.ndarray, kp: np.ndarray, kind: np.ndarray | int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(kp >> 32), pa.array(((kp & 0xFFFFFFFF) << 2) + kind)], ["k1", "k2", "mark"])

    def out(rows: list[np.ndarray], final: bool = False) -> Iterator[pa.RecordBatch]:
        (_, _, k1, kp, flag), (one, both), (one_after, both_after) = near.of(rows, final)
        elsewhere = flag & BOTH > 0
        repeated = (one | one_after | elsewhere | (flag & MULTI > 0)) & (flag & WITNESS == 0)
        whole = both | both_after | (flag & MULTI > 0)
        shows = ~both & (one | elsewhere) | ~both_after & one_after
        kind = np.where(whole, np.where(shows, SHOWN, WHOLE), EDGE)
        go = np.flatnonzero(repeated)
        if len(go):
            yield marks(k1[go], kp[go], kind[go])

    none = [np.zeros(0, np.int64)] * 5
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(5)]
        done = rows[4] == DONE
        if done.any():
            yield marks(rows[2][done], rows[3][done], WHOLE)
        yield from out([r[~done] for r in rows])
    yield from out(none, True)


# Rows on their way: an edge or a block that shows; word that a third digit is dealt by the fourth; a window; bytes to remove;
# WIDE windows of an edge; word that a fourth digit's windows are dealt one by one.
BYTES, TOLD, WINDOW, SPAN, FINER, TOLD_FINER = 0, 1, 2, 3, 4, 5
EDGE_SCHEMA = pa.schema(
    [("key", pa.int64()), ("other", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int64()), ("left", pa.int32()), ("around", pa.binary()), ("edge", pa.bool_()), ("kind", pa.int32())]
)
EDGE_COLUMNS = "key long, other long, k1 long, k2 long, at long, left int, around binary, edge boolean, kind int"
#: Edges whose windows are taken at once.
DEALT = 2000


def _packed(columns: dict[str, np.ndarray], kind: int) -> pa.RecordBatch:
    n = len(columns["k1"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.array([kind] * n if f.name == "kind" else [None] * n if f.name in ("around", "edge") else [0] * n, f.type) for f in EDGE_SCHEMA], schema=EDGE_SCHEMA)


def spans_of(k1: np.ndarray, k2: np.ndarray, at: np.ndarray, windows: np.ndarray, length: int) -> pa.RecordBatch | None:
    """windows[row, d]: does the window repeat that begins d bytes before the row's block? -> the bytes under such windows."""
    step = np.diff(np.pad(windows.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, near = np.nonzero(step == 1)
    _, far = np.nonzero(step == -1)
    if not len(row):
        return None
    return _packed({"k1": k1[row], "k2": k2[row], "at": ((at[row] - (far - 1)) << 32) + (at[row] - near + length)}, SPAN)


def dealt(k1: np.ndarray, k2: np.ndarray, at: np.ndarray, left: np.ndarray, around: list[bytes], length: int, reach: int) -> Iterator[pa.RecordBatch]:
    """The windows of edges and blocks shown: those that repeat among them as spans, and one row for each that differs."""
    digest = xxhash.xxh3_128_digest
    for a in range(0, len(around), DEALT):
        part = slice(a, a + DEALT)
        row, far, found = [], [], []
        for k, (x, n) in enumerate(zip(around[part], left[part].tolist(), strict=True)):
            for d in range(max(0, n + length - len(x)), min(reach, n) + 1):
                row.append(k)
                far.append(d)
                found.append(digest(x[n - d : n - d + length], d))  # a window has its block at one place, and is taken there once
        if not found:
            continue
        w = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        order = np.lexsort((w[:, 1], w[:, 0]))
        w, row, far = w[order], np.array(row)[order], np.array(far)[order]
        first, group = runs(w[:, 0], w[:, 1])
        several = np.bincount(group)[group] > 1
        windows = np.zeros((len(around[part]), reach + 1), bool)
        windows[row[several], far[several]] = True
        if (spans := spans_of(k1[part], k2[part], at[part], windows, length)) is not None:
            yield spans
        # `left`: 1 for a window that others of this task had
        yield _packed({"key": w[first, 0], "other": w[first, 1], "k1": k1[part][row[first]], "k2": k2[part][row[first]], "at": at[part][row[first]] - far[first], "left": several[first].astype(np.int32)}, WINDOW)


def finer(k1: np.ndarray, k2: np.ndarray, at: np.ndarray, left: np.ndarray, around: list[bytes], edge: np.ndarray, length: int, reach: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Edges and blocks shown, each cut into the bytes of WIDE windows side by side. Those that are equal among them are
    spans, and one row stands for them; where many differ, their windows are dealt."""
    digest = xxhash.xxh3_64_intdigest
    for a in range(0, len(around), DEALT):
        part = slice(a, a + DEALT)
        row, key, low, high, held = [], [], [], [], []
        for k, (x, n) in enumerate(zip(around[part], left[part].tolist(), strict=True)):
            least, most = max(0, n + length - len(x)), min(reach, n)
            for first in range(least - least % WIDE, most + 1, WIDE):
                last = min(first + WIDE - 1, reach)
                row.append(k)
                low.append(max(first, least))
                high.append(min(last, most))
                key.append(digest(x[n - first : n - last + length], first + 3) - (1 << 63))  # seeds 1 and 2 are the third digit's
                held.append(x[n - high[-1] : n - low[-1] + length])
        if not row:
            continue
        row, key, low, high = np.array(row), np.array(key, np.int64), np.array(low), np.array(high)
        seen: dict[tuple[int, bytes], int] = {}
        group = np.array([seen.setdefault(x, len(seen)) for x in zip(high.tolist(), held, strict=True)])
        several = np.bincount(group)[group] > 1
        windows = np.zeros((len(around[part]), reach + 1), bool)
        for d in range(WIDE):
            on = several & edge[part][row] & (low + d <= high)
            windows[row[on], low[on] + d] = True
        if (spans := spans_of(k1[part], k2[part], at[part], windows, length)) is not None:
            yield spans
        stands = np.unique(group, return_index=True)[1]
        keys, which, counts = np.unique(key[stands], return_inverse=True, return_counts=True)
        many = counts >= FEWER * max(hot, len(stands) // SPARSE)
        on = stands[many[which]]
        if len(on):
            told = keys[many]
            yield _packed({"key": told, "k1": told * 0, "at": told * 0 - 1}, TOLD_FINER)
            yield from dealt(k1[part][row[on]], k2[part][row[on]], at[part][row[on]], high[on], [held[k] for k in on.tolist()], length, reach)
        on = stands[~many[which]]
        if len(on):
            yield _packed({"key": key[on], "k1": k1[part][row[on]], "k2": k2[part][row[on]], "at": at[part][row[on]], "left": high[on], "around": [held[k] for k in on.tolist()], "edge": edge[part][row[on]] & ~several[on]}, FINER)


def _edges(length: int, block: int, hot: int):
    """Texts with marks -> the bytes around each edge, and around the blocks shown to edges: once for the windows that
    hold the `half` bytes before the block, once for those that hold as many after it."""
    reach = length - block
    half = (reach + 1) // 2
    after = reach - half + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        found: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            t = pa.RecordBatch.from_pydict(dict(zip(EDGE_SCHEMA.names, map(list, zip(*found, strict=True)), strict=True)), EDGE_SCHEMA)
            found.clear()
            keys, which, counts = np.unique(t["key"].to_numpy(), return_inverse=True, return_counts=True)
            many = counts >= max(hot, t.num_rows // SPARSE)
            if many.any():
                told = keys[many]
                yield _packed({"key": told, "k1": told * 0, "at": told * 0 - 1}, TOLD)
                dense = t.filter(pa.array(many[which]))
                yield from finer(*_arrays(dense), dense["edge"].to_numpy(zero_copy_only=False), length, reach, hot)
                t = t.filter(pa.array(~many[which]))
            yield t

        for batch in batches:
            columns = {n: batch.column(n) for n in ("k1", "k2", "marks")}
            for k, row in enumerate(byte_rows(batch.column("row").field("text"))):
                marks = np.unique(np.asarray(columns["marks"][k].values))
                data, k1, k2 = row.tobytes(), columns["k1"][k].as_py(), columns["k2"][k].as_py()
                for mark in marks[marks & 3 != WHOLE].tolist():
                    at = mark >> 2
                    edge, end = mark & 3 == EDGE, at + block + after
                    if at >= half:
                        low = max(0, at - reach)
                        found.append((digest(data[at - half : at + block], 1) - (1 << 63), 0, k1, k2, at, at - low, data[low : at + length - half], edge, BYTES))
                    if end <= len(data):
                        low = max(0, at - half + 1)
                        found.append((digest(data[at:end], 2) - (1 << 63), 0, k1, k2, at, at - low, data[low : at + length], edge, BYTES))
                    if len(found) >= 20_000:
                        yield from out()
        if found:
            yield from out()

    return run


def _arrays(t: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    return t["k1"].to_numpy(), t["k2"].to_numpy(), t["at"].to_numpy(), t["left"].to_numpy().astype(np.int64), t["around"].to_pylist()


def repeated_windows(group: np.ndarray, around: list[bytes], left: np.ndarray, length: int, block: int) -> np.ndarray:
    """[row, d]: does the window that begins d bytes before the row's block come in another row of its group, as far before the block?"""
    m, reach = len(around), length - block
    sizes = np.array([len(x) for x in around])
    table = np.zeros((m, reach + length), np.uint8)
    for k, x in enumerate(around):
        at = reach - left[k]
        table[k, at : at + len(x)] = np.frombuffer(x, np.uint8)
    up, _ = powers(reach + length + 1)
    second = scrambled(_bytes() + np.uint64(1))
    sums = [np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(values[table] * up[: reach + length], axis=1)], axis=1) for values in (_bytes(), second)]
    salt = scrambled(group.astype(np.uint64) + np.uint64(1))
    out = np.zeros((m, reach + 1), bool)
    for d in range(reach + 1):
        rows = np.flatnonzero((left >= d) & (sizes - left >= length - d))
        if len(rows) < 2:
            continue
        first, other = (s[rows, reach - d + length] - s[rows, reach - d] for s in sums)
        first = scrambled(first ^ salt[rows])
        order = np.argsort(first)
        f, o, g = first[order], other[order], group[rows][order]
        equal = (f[1:] == f[:-1]) & (o[1:] == o[:-1]) & (g[1:] == g[:-1])
        like = np.flatnonzero(equal)
        one, two = (table[rows[order[at]], reach - d : reach - d + length] for at in (like, like + 1))
        if length % 8 == 0:
            one, two = one.view(np.uint64), two.view(np.uint64)
        equal[like] = (one == two).all(axis=1)
        out[rows[order], d] = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    return out


def _ordered(length: int, block: int, most: int, hot: int | None = None):
    """Edges and shown blocks in order of their third or fourth digit -> the bytes under repeated windows at edges, and of
    larger groups the windows one by one or, if `hot` is given, rows by the fourth digit. Other rows are passed on."""
    reach = length - block

    def further(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if hot is None:
            return dealt(*_arrays(t), length, reach)
        return finer(*_arrays(t), t["edge"].to_numpy(), length, reach, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, goes_on = 0, None  # rows held; the group that the last rows were dealt of

        def out(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, goes_on
            t = pa.Table.from_batches(held).combine_chunks()
            key, told = t["key"].to_numpy(), np.isin(t["kind"].to_numpy(), (TOLD, TOLD_FINER))
            _, group = runs(key)
            size = np.bincount(group)
            deal = (np.bincount(group, told) > 0) | (size > most)
            if key[0] == goes_on:
                deal[0] = True
            last = int(np.searchsorted(key, key[-1]))
            end = len(key) if final or deal[-1] else last
            goes_on = key[-1] if deal[-1] else None
            held, n = t.slice(end).to_batches(), len(key) - end
            each = deal[group[:end]]
            if each.any():
                yield from further(t.slice(0, end).filter(pa.array(each & ~told[:end])))
            each |= size[group[:end]] < 2
            t, group = t.slice(0, end).filter(pa.array(~each)), group[:end][~each]
            if len(t):
                k1, k2, at, left, around = _arrays(t)
                windows = repeated_windows(group, around, left, length, block) & t["edge"].to_numpy()[:, None]
                if (spans := spans_of(k1, k2, at, windows, length)) is not None:
                    yield spans

        for batch in batches:
            kind = batch["kind"].to_numpy()
            on = kind >= WINDOW if hot is not None else (kind == WINDOW) | (kind == SPAN)
            if on.any():
                yield batch.filter(pa.array(on))
                batch = batch.filter(pa.array(~on))
            for a in range(0, batch.num_rows, most):
                held.append(batch.slice(a, most))
                n += held[-1].num_rows
                if n >= most:
                    yield from out(False)
        if n:
            yield from out(True)

    return run


def _repeats(length: int):
    """Windows in order of their bytes' hash -> those that come again, as spans; spans are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Neighbours(2)

        def out(rows: list[np.ndarray], final: bool = False) -> Iterator[pa.RecordBatch]:
            (_, _, k1, k2, at, left), (_, before), (_, behind) = near.of(rows, final)
            go = np.flatnonzero((before | behind) & (left == 0))  # the others are settled
            if len(go):
                yield pa.RecordBatch.from_arrays([pa.array(k1[go]), pa.array(k2[go]), pa.array((at[go] << 32) + at[go] + length)], ["k1", "k2", "span"])

        for batch in batches:
            rows = [batch[name].to_numpy() for name in ("key", "other", "k1", "k2", "at", "left", "kind")]
            on = rows.pop() == SPAN
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[k][on].astype(np.int64)) for k in (2, 3, 4)], ["k1", "k2", "span"])
            yield from out([r[~on].astype(np.int64) for r in rows])
        yield from out([np.zeros(0, np.int64)] * 6, True)

    return run


def cut(data: np.ndarray, marks: np.ndarray, spans: np.ndarray, length: int, block: int) -> tuple[np.ndarray, int]:
    """The mask of bytes that stay, and the number of maximal removed runs."""
    n, reach = len(data), length - block
    at = marks[marks & 3 != EDGE] >> 2
    low = np.concatenate([np.maximum(at - reach, 0), spans >> 32])
    high = np.concatenate([np.minimum(at + length, n), spans & 0xFFFFFFFF])
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, low, 1)
    np.add.at(depth, high, -1)
    gone = np.cumsum(depth[:-1]) > 0
    return ~gone, int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(n > 0 and gone[0])


def _joined(docs: DataFrame, length: int, block: int, hot: int, hot_edges: int, group: int) -> DataFrame:
    """row (each row of docs, whole), marks and spans: what to cut."""
    _shared.ship(docs.sparkSession)
    keyed = docs.select(_shared.whole(docs).alias("row"))
    text, doc_id = F.coalesce(F.col("row")["text"], F.lit("")), F.col("row")["doc_id"]
    keyed = keyed.select("row", F.xxhash64(doc_id, text).alias("k1"), F.hash(text, F.lit(length)).cast("long").alias("k2"))  # 96 bits for a row; rows alike in both are alike
    blocks = keyed.select(text.alias("text"), "k1", "k2").mapInArrow(_blocks(length, block, hot), "h1 long, h2 long, k1 long, kp long, flag int")
    flag, done = F.col("flag"), F.col("flag") == DONE
    place = F.when(done, F.xxhash64("k1", "kp")).when(flag.bitwiseAND(BOTH) > 0, F.xxhash64("h1", "h2")).otherwise(F.col("h1"))
    marks = blocks.repartition(place).sortWithinPartitions(done, "h1", "h2").mapInArrow(_survivors, "k1 long, k2 long, mark long")
    marks = _shared.spilled(marks.groupBy("k1", "k2").agg(F.collect_set("mark").alias("marks")), "marks")
    texts = keyed.repartition("k1", "k2")
    # all columns of texts go on here, so that the exchange is the one that the last join reads as well
    shown = texts.join(marks.where(F.exists("marks", lambda m: m.bitwiseAND(3) != WHOLE)), ["k1", "k2"])
    edges = shown.mapInArrow(_edges(length, block, hot_edges), EDGE_COLUMNS)
    far = F.when(F.col("kind") < WINDOW, F.col("key")).otherwise(F.xxhash64("k1", "at", "other"))
    edges = edges.repartition(far).sortWithinPartitions(F.col("kind") < WINDOW, "key", "at")
    edges = edges.mapInArrow(_ordered(length, block, group, hot_edges), EDGE_COLUMNS)
    far = F.when(F.col("kind") >= FINER, F.col("key")).otherwise(F.xxhash64("k1", "at", "other"))
    edges = edges.repartition(far).sortWithinPartitions(F.col("kind") >= FINER, "key", "at")
    found = edges.mapInArrow(_ordered(length, block, group), EDGE_COLUMNS).drop("around", "edge")
    far = F.when(F.col("kind") == WINDOW, F.xxhash64("key", "other")).otherwise(F.xxhash64("k1", "k2"))
    spans = found.repartition(far).sortWithinPartitions("key", "other").mapInArrow(_repeats(length), "k1 long, k2 long, span long")
    facts = marks.join(spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans")), ["k1", "k2"], "left")
    return texts.join(facts, ["k1", "k2"], "left").select("row", "marks", "spans")


def _numbers(x: pa.Scalar) -> np.ndarray:
    return np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64)


def remaining(docs: DataFrame, length: int = LENGTH, block: int = BLOCK, hot: int = HOT, hot_edges: int = HOT_EDGES, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            rows, marks, spans = batch.columns
            for k, data in enumerate(byte_rows(rows.field("text"))):
                stays, runs_ = cut(data, _numbers(marks[k]), _numbers(spans[k]), length, block)
                found.append((len(data), len(data) - int(stays.sum()), runs_, data[stays].tobytes()))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([rows.field("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = _joined(docs.select("doc_id", "text"), length, block, hot, hot_edges, group)
    schema = StructType([docs.schema["doc_id"], *[StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")], StructField("kept", BinaryType())])
    return joined.mapInArrow(run, schema)


def stripped_documents(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """The rows of docs, whole, without the repeated passages in text; n_chars, if there, counts what is left.

    Where a cut goes through a character, its other bytes go too. A text of which nothing is left is empty.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks, spans = batch.columns
            texts, whole = [], rows.field("text")
            for k, data in enumerate(byte_rows(whole)):
                if not whole[k].is_valid or not marks[k].is_valid:
                    texts.append(whole[k].as_py())
                    continue
                stays, _ = cut(data, _numbers(marks[k]), _numbers(spans[k]), length, block)
                texts.append(data[stays].tobytes().decode("utf-8", "ignore"))
            columns = {n: rows.field(n) for n in names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in names:
                kept = [n if not m.is_valid else len(t or "") for n, m, t in zip(columns["n_chars"].to_pylist(), marks, texts, strict=True)]
                columns["n_chars"] = pa.array(kept, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    joined = _joined(docs, length, block, HOT, HOT_EDGES, GROUP)
    schema = StructType([StructField(n, StringType()) if n == "text" else docs.schema[n] for n in names])
    return joined.mapInArrow(run, schema)
