"""Packing token sequences by minimum bin slack.

Documents become token ids, the id 1 at the end. What fills whole windows goes out at once. The remaining pieces of a
task are a multiset of lengths; for each window the longest is the seed, and a subset-sum dynamic program over a
bitset (a Python integer, one bit for every sum within reach) picks those others that come closest to the capacity,
walking back through the bitsets for how many of each length. The same filling is used again as often as the counts
allow. Where even the best filling leaves a gap, documents being freely cut, a piece is cut to close it; what is left
at the end of a task is cut into powers of two. So nothing is padded, and no row leaves its task: no shuffle.

Defined results: a null or empty text is the one id 1. Rows that repeat an id are packed each for itself. An empty
table gives an empty result. Only doc_id and text are looked at. sequence_id is the task's number times 2**33 plus a
count; it is the same in a rerun over the same input splits.
"""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

CAPACITY = 2048
END_ID = 1
#: Pieces that wait before windows are filled from them, and bytes of words and ids that a worker remembers.
WAITING = 4096
REMEMBERED = 1 << 26
#: About what a remembered word takes besides its letters and ids.
WORD_BYTES = 160
_words: dict[str, Words] = {}


def fill(counts: dict[int, int], order: list[int], target: int) -> dict[int, int]:
    """How many of each length to take for the largest sum not over target. order: the lengths, ascending."""
    mask, reach, steps = (1 << target + 1) - 1, 1, []
    for at in range(bisect.bisect_right(order, target) - 1, -1, -1):
        length = order[at]
        left, part, now = min(counts[length], target // length), 1, reach
        while left > 0:  # 1, 2, 4, ... copies at once, then the rest
            part = min(part, left)
            now |= now << length * part & mask
            left -= part
            part *= 2
        if now != reach:
            steps.append((length, reach))
            reach = now
            if reach >> target & 1:
                break
    at, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            taken[length] = n
    return taken


class Packer:
    """Pieces in, (piece, sequence, offset) out. A piece is a tuple whose second and third are its start and ids."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.sequence = capacity, base
        self.lengths: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.order: list[int] = []
        self.waiting = 0

    def add(self, piece: tuple) -> None:
        length = len(piece[2])
        if length not in self.lengths:
            self.lengths[length], self.counts[length] = [], 0
            bisect.insort(self.order, length)
        self.lengths[length].append(piece)
        self.counts[length] += 1
        self.waiting += 1

    def _pop(self, length: int) -> tuple:
        piece = self.lengths[length].pop()
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.lengths[length], self.counts[length]
            del self.order[bisect.bisect_left(self.order, length)]
        self.waiting -= 1
        return piece

    def window(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield piece, self.sequence, at
            at += len(piece[2])
        self.sequence += 1

    def drain(self, least: int) -> Iterator[tuple]:
        """Fills windows while more than `least` pieces wait."""
        while self.waiting > least:
            longest = self.order[-1]
            seed = self._pop(longest)
            taken = fill(self.counts, self.order, self.capacity - longest)
            self.add(seed)
            taken[longest] = taken.get(longest, 0) + 1
            gap = self.capacity - sum(k * n for k, n in taken.items())
            if gap and not least:
                break  # the last pieces of all
            for _ in range(1 if gap else min(self.counts[k] // n for k, n in taken.items())):
                pieces = [self._pop(k) for k, n in taken.items() for _ in range(n)]
                if gap and self.waiting:
                    name, start, ids, total = self._pop(self.order[-1])
                    pieces.append((name, start, ids[:gap], total))
                    if len(ids) > gap:
                        self.add((name, start + gap, ids[gap:], total))
                yield from self.window(pieces)

    def close(self) -> Iterator[tuple]:
        """All that waits: windows cut full, the last tokens in windows of powers of two."""
        yield from self.drain(0)
        left = [p for k in self.order for p in self.lengths[k]]
        room = sum(len(p[2]) for p in left)
        self.lengths, self.counts, self.order, self.waiting = {}, {}, [], 0
        while room:
            size = self.capacity if room >= self.capacity else 1 << room.bit_length() - 1
            room -= size
            pieces = []
            while size:
                name, start, ids, total = left.pop()
                pieces.append((name, start, ids[:size], total))
                if len(ids) > size:
                    left.append((name, start + size, ids[size:], total))
                size -= len(pieces[-1][2])
            yield from self.window(pieces)


#: Words for which lower-casing and splitting can be done here: printable ASCII and the Latin letters that stand alone.
PLAIN = re.compile("[\\x21-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*")
#: Fixed value: the split pattern of this vocabulary, for such words.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, others follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = (b for b in range(256) if b not in set(shown))
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Words:
    """Token ids of whole texts. No token of a vocabulary with word ends spans white space, so each blank-separated
    word is tokenised once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.room = REMEMBERED

    @staticmethod
    def at(path: str) -> Words:
        """The worker's own, kept from task to task."""
        if path not in _words:
            _words[path] = Words(path)
        return _words[path]

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            spelt = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
            found = self.parts[part] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])
            self.room -= WORD_BYTES + 2 * len(part) + len(found)
        return found

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join([self._part(p) for p in PARTS.findall(word.lower())])
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str, last: int) -> np.ndarray:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.known
        new = {w for w in words if w not in known}
        if new:
            if self.room <= 0:
                known.clear()
                self.parts.clear()
                self.room, new = REMEMBERED, set(words)
            for w in new:
                known[w] = found = self._word(w)
                self.room -= WORD_BYTES + 2 * len(w) + len(found)
        ids = np.frombuffer(b"".join([known[w] for w in words]) + last.to_bytes(4, "little"), "<u4")
        if self.room < -REMEMBERED:  # a text of very many words of its own
            known.clear()
            self.parts.clear()
            self.room = REMEMBERED
        return ids


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = Words.at(tokenizer), Packer(capacity, TaskContext.get().partitionId() << 33)
        type_ = None

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[(p[0], p[1], len(p[2]), p[2].tobytes(), p[3], s, at) for p, s, at in found], strict=True))
            kinds = [type_, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        held: list[tuple] = []
        for batch in batches:
            type_ = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "", end_id)
                whole = len(ids) // capacity * capacity
                for start in range(0, whole, capacity):
                    held += packer.window([(name, start, ids[start : start + capacity], len(ids))])
                if whole < len(ids):
                    packer.add((name, whole, ids[whole:].copy(), len(ids)))
                if packer.waiting >= WAITING:
                    held += packer.drain(WAITING // 4)
                if len(held) >= 2000:
                    yield out(held)
                    held = []
        held += packer.close()
        if held:
            yield out(held)

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    schema = StructType([StructField("doc_id", kind), *[StructField(n, BinaryType() if n == "ids" else LongType()) for n in names[1:]]])
    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, used, pieces (in order) and padding to the capacity or the power of two."""
    used = F.sum("length")
    return pieces.groupBy("sequence_id").agg(used.alias("used"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length"))).alias("pieces"))
