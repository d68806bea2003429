"""Operator 9: SentencePiece encoding and decoding by weighted finite-state transducers.

Three weighted machines are compiled from a model file:

* normaliser: the model's table of replacements, of which the longest that matches is
  taken at each place (leftmost first); blanks at the ends and runs of them go, if the
  model says so; blanks become the mark U+2581 and the dummy prefix is put in;
* pieces: a trie from characters to pieces, each with its weight, -score;
* byte fallback: a character without a piece goes to the ids of its UTF-8 bytes, or to
  the unknown id where there are none, at the weight of 10 beyond the worst piece.

A text is put through the normaliser and composed with the other two; its encoding is
the shortest path of the composition in the tropical semiring (weights add along a path,
the least of the paths into a state is kept; of equal ones the one with the longest
last piece, which is found first).

A unigram model is that composition. A BPE model merges by rank, whatever the sum of
scores, and is composed with one more acceptor, whose states are pieces and whose arc
from piece a to piece b weighs nothing if merging a + b gives a, b again, and infinity
otherwise. A sequence is the BPE encoding of its text if and only if every adjacent pair
has a finite arc. Arcs of this acceptor are made when first asked for. Equal ranks (runs
of blanks) break that property; a unit with such a run is one arc, made by merging.

Characters that no piece joins cut the text into units; the paths of units that
recur are kept in bounded tables, those of very long units are not.

A null or empty text has no ids and decodes to the empty text. Repeated rows are encoded
alike. Long texts are encoded whole. An empty table gives no rows. Columns beyond doc_id
and text are not read. Models with user-defined pieces are refused.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tokens import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
INFINITE = float("inf")
UNIGRAM, BPE = 1, 2
MOST_UNITS, MOST_ARCS, LONG_UNIT = 400_000, 400_000, 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({5: 4, 1: 8}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Replacements:
    """The normaliser's table: a double array over the bytes of what is replaced, and the replacements, each ended by a zero.

    Fixed values: the layout of a unit. Bits 0-7 are its label and bit 31 marks values; bit 8
    says that a value follows; bits 10-30 are the offset to its children, in steps of 256 if bit 9 is set.
    """

    def __init__(self, table: bytes):
        (size,) = struct.unpack_from("<I", table, 0)
        self.units = np.frombuffer(table, "<u4", size // 4, 4).tolist()
        self.texts = table[4 + size :]

    @staticmethod
    def offset(unit: int) -> int:
        return (unit >> 10) << (8 if unit & 512 else 0)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes that the longest match at a place takes, and what replaces them."""
        units, found = self.units, None
        node = self.offset(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= self.offset(unit)
            if unit & 256:
                start = units[node] & 0x7FFFFFFF
                found = end + 1 - at, self.texts[start : self.texts.index(0, start)]
        return found


class Transducer:
    """Compiled from the bytes of a model file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.kind, self.prefix, self.squeeze, self.mark = UNIGRAM, True, True, True
        self.replacements: Replacements | None = None
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
                self.prefix, self.squeeze, self.mark = (bool(norm.get(k, 1)) for k in (3, 4, 5))
                self.replacements = Replacements(norm[2]) if norm.get(2) else None
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("unigram and BPE models only")
        if USER in kinds:
            raise ValueError("user-defined pieces are not compiled")
        self.unk = kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        # the piece machine: nested tables, the piece that ends at a state under ""
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        joined = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        plain = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
        stops = "".join(p for p in plain if not any(b == p and a.isascii() and a.isalnum() for a, b in joined))
        self.odd = re.compile("[" + "".join({re.escape(a) for a, b in joined if b in stops and a not in stops and a != MARK}) + "]|(?!)") if any(b in stops and a not in stops and a != MARK for a, b in joined) else re.compile("(?!)")
        one = re.escape(stops)
        line = "" if any("\n" in p for p in joined) else "\n"
        self.fine = re.compile(f"{MARK}*[^{MARK}{line}{one}]+|{MARK}*[{one}][^{MARK}{line}]*|{MARK}+|\n") if stops else None
        inner = any(b == MARK and a != MARK for a, b in joined)
        self.coarse = re.compile("(?s).+" if inner else f"{MARK}*[^{MARK}]+|{MARK}+")
        if inner:
            self.fine = None
        self.surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode()
            for p, k in zip(self.pieces, kinds)
        ]
        self.units: dict[str, bytes] = {}
        self.arcs: dict[int, bool] = {}
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0

    # -- machines

    def normalise(self, text: str) -> str:
        if self.replacements is not None:
            data, at, out = text.encode("utf-8", "replace"), 0, []
            while at < len(data):
                found = self.replacements.longest(data, at)
                if found is None:  # one character as it is
                    end = at + 1
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end += 1
                    found = end - at, data[at:end]
                out.append(found[1])
                at += found[0]
            text = b"".join(out).decode("utf-8", "replace")
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.mark else text

    def fallback(self, char: str) -> list[int]:
        found = [self.bytes.get(b) for b in char.encode("utf-8", "replace")]
        return [self.unk] if None in found else found

    def merged(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging the best-ranked pair, the leftmost of equals."""
        part: list[str | None] = list(text)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids, scores = self.ids, self.scores
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := ids.get(part[i] + part[j])) is not None:
                heap.append((-scores[k], i, len(part[i]) + len(part[j])))

        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (k := ids.get(part[left] + part[right])) is not None:
                    heapq.heappush(heap, (-scores[k], left, len(part[left]) + len(part[right])))
        return [p for p in part if p is not None]

    def arc(self, a: int, b: int) -> bool:
        """Whether the BPE acceptor goes from piece a to piece b."""
        key = a * len(self.pieces) + b
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            left, right = self.pieces[a], self.pieces[b]
            found = self.arcs[key] = self.merged(left + right) == [left, right]
        return found

    # -- composition with a unit and its shortest path

    def path(self, unit: str) -> list[int]:
        """Ids on the shortest path of the composition with a unit."""
        bpe = self.kind == BPE
        if bpe and MARK + MARK in unit:
            return self.merged_ids(unit)
        n, size = len(unit), len(self.pieces)
        trie, arcs, scores = self.trie, self.arcs, self.scores
        cost = [INFINITE] * (n + 1)
        last, start = [-1] * (n + 1), [0] * (n + 1)  # the piece that ends here on the best path, and where it begins
        cost[0] = 0.0
        for i in range(n):
            here = cost[i]
            if here == INFINITE:
                continue
            node, j, single, base = trie, i, False, last[i] * size
            while j < n and (node := node.get(unit[j])) is not None:
                j += 1
                k = node.get("")
                if k is None:
                    continue
                single = single or j == i + 1
                weight = here - scores[k]
                if weight >= cost[j]:
                    continue
                if bpe:
                    good = self.arc_alone(k) if last[i] < 0 else arcs.get(base + k)
                    if good is None:
                        good = self.arc(last[i], k)
                    if not good:  # an arc of infinite weight
                        continue
                cost[j], last[j], start[j] = weight, k, i
            # A character by bytes joins nothing, so that the acceptor starts afresh behind it.
            if not single and (not bpe or unit[i] not in trie) and here - self.worst < cost[i + 1]:
                cost[i + 1], last[i + 1], start[i + 1] = here - self.worst, -1, i
        if cost[n] == INFINITE:  # a character that is no piece but part of some
            return self.merged_ids(unit)
        out: list[list[int]] = []
        while n:
            out.append(self.fallback(unit[start[n] : n]) if last[n] < 0 else [last[n]])
            n = start[n]
        return [k for part in reversed(out) for k in part]

    def merged_ids(self, unit: str) -> list[int]:
        return [k for p in self.merged(unit) for k in ([self.ids[p]] if p in self.ids else self.fallback(p))]

    def arc_alone(self, k: int) -> bool:
        """Whether a piece is the encoding of its own text."""
        key = -1 - k
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= MOST_ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self.merged(self.pieces[k]) == [self.pieces[k]]
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        text = self.normalise(text)
        cut = self.coarse if self.fine is None or self.odd.search(text) else self.fine
        units = cut.findall(text)
        kept = self.units
        try:
            out = b"".join(map(kept.__getitem__, units))
        except KeyError:
            out = b"".join([kept.get(u) or self.unit(u) for u in units])
        return out if self.bytes else self.one_unknown(out)

    def unit(self, unit: str) -> bytes:
        """The ids of a unit; the table starts afresh when it is full, and long units are not kept."""
        found = struct.pack(f"<{len(p := self.path(unit))}i", *p)
        if len(unit) <= LONG_UNIT:
            if len(self.units) >= MOST_UNITS:
                self.units.clear()
            self.units[unit] = found
        return found

    def one_unknown(self, ids: bytes) -> bytes:
        """Unknown characters in a row are one unknown."""
        found = np.frombuffer(ids, "<i4")
        again = np.zeros(len(found), dtype=bool)
        again[1:] = (found[1:] == self.unk) & (found[:-1] == self.unk)
        return found[~again].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        out = b"".join([surface[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return out[1:] if (self.prefix or self.squeeze) and out.startswith(" ") else out


_MADE: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The machines of a model file that every node has, made once a worker."""
    if path not in _MADE:
        with open(path, "rb") as f:
            _MADE[path] = Transducer(f.read())
    return _MADE[path]


def encoded(docs: DataFrame, model: str, decode: bool = True) -> DataFrame:
    """doc_id, n_ids, ids and (with ``decode``) the text that the ids decode to, for every row.

    A null or empty text has no ids and decodes to the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            texts = pc.fill_null(batch["text"], "")
            size = pc.binary_length(texts).to_numpy().astype(np.int64)
            for a, b in slices(size + 1, 2 << 20):
                blobs = [machine.encode(t) for t in texts.slice(a, b - a).to_pylist()]
                flat = np.frombuffer(b"".join(blobs), dtype="<i4")
                long = np.fromiter((len(x) // 4 for x in blobs), np.int32, len(blobs))
                ends = np.concatenate(([0], np.cumsum(long))).astype(np.int32)
                columns = [batch["doc_id"].slice(a, b - a), pa.array(long), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                names = ["doc_id", "n_ids", "ids"]
                if decode:
                    columns.append(pa.array([machine.decode(flat[x:y]) for x, y in zip(ends, ends[1:])], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids int, ids array<int>" + ", decoded string" * decode)
