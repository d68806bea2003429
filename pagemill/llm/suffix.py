"""Operator 6: scoring texts with a probabilistic suffix tree.

A text is the sequence of its words, A-Z lower-cased, and one end. The tree reads it as
bytes: words with one blank between them, then the end. Its states are contexts of up to
``DEPTH`` preceding bytes, whatever words they lie in; before a text are ends.

1. The windows (context and next byte) of all training texts are counted. A task sends
   them, summed and sorted, as one packed row for each of its shards, so that the counts
   cover the whole corpus and few rows move.
2. A context is a candidate if it occurs ``MIN_COUNT`` times: nothing is cut by share, so
   that the tree grows with the corpus.
3. A candidate is retained if its next-byte distribution diverges from that of its
   suffix, one byte shorter, by at least ``BITS`` bits (Kullback-Leibler) and, over all
   its occurrences, ``GAIN`` bits for each byte seen to follow, or if a longer retained
   context ends in it. Contexts of up to ``LOW`` bytes are all retained: they name the
   shard in which the longer ones that end in them are built, each in one task.
4. A state's distribution is its counts plus ``PRIOR`` for each byte seen times the
   smoothed distribution of its suffix; the root's adds one for each of 256 bytes. Only
   bytes seen are stored; the rest of the weight goes to the suffix.
5. A byte is scored in the state of the longest suffix of its context. A tree of up to
   ``MOST_ROWS`` rows is broadcast at once. A larger one goes out by groups of shards; a
   pass over the texts for each group scores the bytes whose contexts end in its shards,
   so that each byte is looked up once however many passes there are.

The base score needs the training count of every word of every document. Chunks
of documents list their distinct words, so that words are joined to their counts
once a chunk and not once a document; words that many chunks list are broadcast, up to a
fixed number, so that no task gets all rows of one word.

A null or empty text has only the end. Repeated rows are scored alike and counted as
often as they occur; a null doc_id counts as the empty id. Long texts are read whole.
Without training texts every byte has the same probability, and the base score is zero.
An empty table gives no rows. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import doc_fold, even_join, written
from pagemill.llm.tokens import byte_table, mapped, raw_bytes, slices, words

#: No word holds a line end, so that it can stand for the end and for what precedes a text.
END, BLANK = 10, 32
#: Contexts of seven bytes at most go into one number with the next byte.
DEPTH, LOW = 6, 2
MIN_COUNT = 8
BITS = 0.02
GAIN = 3.0
PRIOR = 2.0
CHUNK = 8 << 20
HELD_WINDOWS = 600_000
#: Rows of a tree that are broadcast at once, 16 bytes each.
MOST_ROWS = 4_000_000
#: A word that more chunks list is joined by broadcast.
HUB = 16


def _context(key: np.ndarray, d: int, depth: int) -> np.ndarray:
    """The d bytes before the next byte of windows of ``depth``, the nearest first: windows in order are in order by every d."""
    return key >> np.uint64(8 * (depth - d + 1))


def _with_next(context: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (context << np.uint64(8)) | (key & np.uint64(255))


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of numbers, the numbers in it, and which of these are first of their kind."""
    order = np.argsort(key)
    names = key[order]
    new = np.ones(len(names), dtype=bool)
    np.not_equal(names[1:], names[:-1], out=new[1:])
    return order, names, new


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, np.zeros(0)
    order, names, new = _sorted(key)
    return names[new], np.add.reduceat(n[order].astype(np.float64), np.flatnonzero(new))


@dataclass
class Level:
    """States of one length: their contexts with each next byte seen, as one number, in order; its probability; and the weight that the state leaves to its suffix."""

    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    p: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def step(self, wanted: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted contexts (with next bytes) are states, and the probability there; p: that of their suffixes.

        A state has its bytes side by side, so that one search finds it whether or not the byte was seen.
        """
        if not len(self.seen):
            return np.zeros(len(wanted), dtype=bool), p
        at = np.searchsorted(self.seen, wanted)
        np.minimum(at, len(self.seen) - 1, out=at)
        there = self.seen[at] == wanted
        value = self.p[at].astype(np.float64)
        miss = np.flatnonzero(~there)
        if len(miss):
            right, context = at[miss], wanted[miss] >> np.uint64(8)
            own = (self.seen[right] >> np.uint64(8)) == context
            right[~own] = np.maximum(right[~own] - 1, 0)  # the state's bytes may all be smaller
            there[miss] = (self.seen[right] >> np.uint64(8)) == context
            value[miss] = self.rest[right] * p[miss]
        return there, value


def root_of(n: np.ndarray) -> np.ndarray:
    """From the counts of the 256 bytes."""
    return (n + 1.0) / (n.sum() + 256.0)


def grow(key: np.ndarray, n: np.ndarray, first: int, last: int, depth: int, above: tuple[np.ndarray, np.ndarray], all_kept: bool = False) -> list[Level]:
    """States of ``first`` to ``last`` bytes from windows of ``depth`` (distinct or not) and their counts.

    above: the smoothed probabilities of all windows of one byte less, as sorted windows and values.
    """
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, Level]] = []
    for d in range(first, last + 1):
        seen, counts = _summed(_with_next(_context(key, d, depth), key), n)
        context, owner = np.unique(seen >> np.uint64(8), return_inverse=True)
        total = np.bincount(owner, counts, len(context))
        kinds = np.bincount(owner, minlength=len(context))
        often = (total >= MIN_COUNT)[owner]
        up = above[1][np.searchsorted(above[0], _with_next(seen >> np.uint64(16), seen))]
        weight = PRIOR * kinds
        p = (counts + weight[owner] * up) / (total + weight)[owner]
        # A rarer context is no state; the longer ones that end in it are rarer still.
        p = np.where(often, p, up)
        above = (seen, p)
        share = counts / total[owner]
        apart = np.maximum(np.bincount(owner, share * np.log2(share / up), len(context)), 0.0)
        kept = total >= MIN_COUNT
        if not all_kept:
            kept &= (apart >= BITS) & (apart * total >= GAIN * kinds)
        levels.append((context, kept, owner, Level(seen, p.astype(np.float32), (weight / (total + weight)).astype(np.float32)[owner])))
    out: list[Level] = []
    needed = np.zeros(0, np.uint64)
    for context, kept, owner, level in reversed(levels):
        kept |= np.isin(context, needed)
        needed = np.unique(context[kept] >> np.uint64(8))
        rows = kept[owner]
        out.append(Level(level.seen[rows], level.p[rows], level.rest[rows]))
    return out[::-1]


@dataclass
class Tree:
    """depth of windows; root: 256 probabilities; levels: states of 1, 2, ... bytes."""

    depth: int
    root: np.ndarray
    levels: list[Level]

    def __post_init__(self) -> None:
        """Of all pairs of bytes the probability in the state of the first, or in the root."""
        pairs = np.arange(1 << 16, dtype=np.uint64)
        own = self.root[(pairs & np.uint64(255)).astype(np.int64)]
        there, p = (self.levels[0] if self.levels else Level()).step(pairs, own)
        self.pairs, self.pair_state = np.where(there, p, own), there

    def log10(self, key: np.ndarray) -> np.ndarray:
        """Of the next byte of each window, in the state of the longest suffix of its context."""
        order, windows, new = _sorted(key)
        windows = windows[new]
        pair = _with_next(_context(windows, 1, self.depth), windows).astype(np.int64)
        p = self.pairs[pair]
        alive = np.flatnonzero(self.pair_state[pair])
        for d, level in enumerate(self.levels[1:], 2):
            own = windows[alive]
            there, value = level.step(_with_next(_context(own, d, self.depth), own), p[alive])
            if not there.all():
                alive, value = alive[there], value[there]
            if not len(alive):
                break
            p[alive] = value
        out = np.empty(len(key))
        out[order] = np.log10(p)[np.cumsum(new) - 1]
        return out


def one_tree(key: np.ndarray, n: np.ndarray, depth: int, low: int = 0) -> Tree:
    """The tree of windows in memory; contexts of up to ``low`` bytes are all retained."""
    root = root_of(np.bincount((key & np.uint64(255)).astype(np.int64), n, 256))
    above = (np.arange(256, dtype=np.uint64), root)
    levels: list[Level] = []
    if low:
        levels = grow(key, n, 1, low, depth, above, all_kept=True)
        above = smoothed(root, key, n, low, depth)
    return Tree(depth, root, levels + (grow(key, n, low + 1, depth, depth, above) if depth > low else []))


def smoothed(root: np.ndarray, key: np.ndarray, n: np.ndarray, last: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of ``last`` bytes of context with their smoothed probabilities."""
    above = (np.arange(256, dtype=np.uint64), root)
    for d in range(1, last + 1):
        seen, counts = _summed(_with_next(_context(key, d, depth), key), n)
        context, owner = np.unique(seen >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(owner, counts, len(context)), np.bincount(owner, minlength=len(context))
        up = above[1][np.searchsorted(above[0], _with_next(seen >> np.uint64(16), seen))]
        p = (counts + PRIOR * kinds[owner] * up) / (total + PRIOR * kinds)[owner]
        above = (seen, np.where((total >= MIN_COUNT)[owner], p, up))
    return above


# -- windows


def stream(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, ``depth`` ends before each and after the last; and the place of each text's end."""
    trimmed = pc.ascii_trim(mapped(texts, byte_table(lower=True)), characters=" ")
    ends = pa.scalar("\n" * depth, pa.large_string())
    raw, offsets = raw_bytes(pc.binary_join_element_wise(trimmed, ends, pa.scalar("", pa.large_string())))
    blank = raw == BLANK
    double = blank[1:] & blank[:-1]
    if double.any():  # of a run of blanks the last stays
        gone = np.flatnonzero(double)
        raw = np.delete(raw, gone)
        offsets = offsets - np.searchsorted(gone, offsets)
    return np.concatenate((np.full(depth, END, dtype=np.uint8), raw)), offsets[1:]  # depth ends before, as many after each text


def windows(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte and end of the texts in turn the ``depth`` bytes before it and itself, as one number; and where each text's begin."""
    data, at = stream(texts, depth)
    place = np.ones(len(data), dtype=bool)
    place[:depth] = False
    for k in range(1, depth):
        place[at + k] = False
    place[at[-1] + 1 :] = False
    out = np.zeros(len(data), dtype=np.uint64)
    out[1:] = data[:-1]
    held = 1  # bytes before each place that ``out`` has, the nearest first
    while held < depth:
        more = min(held, depth - held)
        further = out[:-held] >> np.uint64(8 * (held - more))
        out <<= np.uint64(8 * more)
        out[held:] |= further
        held += more
    out <<= np.uint64(8)
    out |= data
    size = np.diff(np.concatenate(([0], at))) - np.concatenate(([depth - 1], np.full(len(at) - 1, depth - 1)))
    return out[place], np.cumsum(size) - size


def _text_slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    return slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8, most)


def _arrays(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    table = rows.toArrow()
    return [table[c].to_numpy() for c in columns]


#: A packed row: the windows of a shard and their counts; shard -1: counts of windows of LOW bytes.
PACKED = "shard int, key binary, n binary"


def _packed(key: np.ndarray, n: np.ndarray, width: int) -> tuple[bytes, bytes]:
    """Sorted keys by planes of their low ``width`` bytes, of which the high ones hardly change; counts as a byte, or as four behind all where that does not hold them."""
    planes = key.view(np.uint8).reshape(-1, 8)[:, :width].T
    return np.ascontiguousarray(planes).tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u4").tobytes()


def _unpacked(row_key: bytes, row_n: bytes, width: int, high: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys, with ``high`` above their low bytes, and counts."""
    planes = np.frombuffer(row_key, np.uint8).reshape(width, -1)
    key = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    key[:, :width] = planes.T
    n = np.frombuffer(row_n, np.uint8, planes.shape[1]).astype(np.float64)
    n[n == 255] = np.frombuffer(row_n, "<u4", offset=planes.shape[1])
    return key.view(np.uint64)[:, 0] | np.uint64(high << (8 * width)), n


def _count(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    held = 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        key, n = _summed(np.concatenate(keys), np.concatenate(counts))
        return key, n.astype(np.int64)

    def sent(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        shard = _context(key, LOW, depth).astype(np.int32)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(key)]))
        short, m = _summed(_with_next(_context(key, LOW, depth), key), n)
        names = [*shard[cuts[:-1]].tolist(), -1]
        made = [_packed(key[a:b], n[a:b], depth + 1 - LOW) for a, b in zip(cuts, cuts[1:])] + [_packed(short, m, LOW + 1)]
        blobs, sizes = [x for x, _ in made], [y for _, y in made]
        for a in range(0, len(names), 500):
            yield pa.RecordBatch.from_arrays([pa.array(names[a : a + 500], pa.int32()), pa.array(blobs[a : a + 500], pa.binary()), pa.array(sizes[a : a + 500], pa.binary())], ["shard", "key", "n"])

    for batch in batches:
        for a, b in _text_slices(batch["text"], 1 << 20):
            key, n = np.unique(windows(batch["text"].slice(a, b - a), depth)[0], return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held >= 2 * HELD_WINDOWS:
                key, n = summed()
                keys, counts, held = [key], [n], len(key)
                if held >= HELD_WINDOWS:  # few repeat: no use in keeping them
                    yield from sent(key, n)
                    keys, counts, held = [key[:0]], [n[:0]], 0
        pa.default_memory_pool().release_unused()
    yield from sent(*summed())


def _low_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, n in zip(batch["key"].to_pylist(), batch["n"].to_pylist()):
            key, m = _unpacked(k, n, LOW + 1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(m.astype(np.int64))], ["key", "n"])


# -- the tree


TREE = "shard int, d int, seen long, p float, rest float"


def _shards(batches: Iterator[pa.RecordBatch], low: tuple[np.ndarray, np.ndarray], depth: int) -> Iterator[pa.RecordBatch]:
    """The states of more than LOW bytes, shard by shard, from packed rows sorted by shard."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held, shard = 0, -1

    def rows() -> Iterator[pa.RecordBatch]:
        levels = grow(np.concatenate(keys), np.concatenate(counts), LOW + 1, depth, depth, low)
        for d, level in enumerate(levels, LOW + 1):
            for a in range(0, len(level.seen), 1 << 16):
                own = slice(a, a + (1 << 16))
                size = len(level.seen[own])
                columns = [np.full(size, shard, np.int32), np.full(size, d, np.int32), level.seen[own].view(np.int64), level.p[own], level.rest[own]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], [c.split()[0] for c in TREE.split(", ")])

    for batch in batches:
        for s, k, n in zip(batch["shard"].to_pylist(), batch["key"].to_pylist(), batch["n"].to_pylist()):
            if s != shard and keys:
                yield from rows()
                keys, counts, held = [], [], 0
            shard = s
            key, m = _unpacked(k, n, depth + 1 - LOW, s)
            keys.append(key)
            counts.append(m)
            held += len(key)
            if held > 2 * HELD_WINDOWS:  # what many tasks sent is summed as it comes
                key, m = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [key], [m], 0
    if keys:
        yield from rows()


def fit(docs: DataFrame, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The root and the LOW levels, of at most 2**24 windows, on the driver; the further states as a stored table (TREE)."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    packed = written(texts.mapInArrow(lambda it: _count(it, depth), PACKED), "suffix-windows", "zstd")
    short = packed.filter("shard = -1").mapInArrow(_low_rows, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    key, n = _arrays(short, "key", "n")
    key, n = key.view(np.uint64), n.astype(np.float64)
    top = one_tree(key, n, LOW, LOW)
    low = smoothed(top.root, key, n, LOW, LOW)
    rows = packed.filter("shard >= 0").repartition("shard").sortWithinPartitions("shard")
    return Tree(depth, top.root, top.levels), written(rows.mapInArrow(lambda it: _shards(it, low, depth), TREE), "suffix-tree")


def shard_groups(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Shards (number, rows) in groups of at most ``most`` rows; a larger shard stands alone."""
    out: list[list[int]] = []
    held = most + 1
    for shard, n in sorted(sizes):
        if held + n > most:
            out.append([])
            held = 0
        out[-1].append(shard)
        held += n
    return out


def trees(top: Tree, states: DataFrame, depth: int, most: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """The tree by groups of shards of ``most`` rows, each with a mark for the contexts that it scores."""
    sizes = [(r.shard, r["count"]) for r in states.groupBy("shard").count().collect()]  # at most 2**16
    groups = shard_groups(sizes, most) or [[]]
    for i, group in enumerate(groups):
        mine = np.zeros(1 << (8 * LOW), dtype=bool)
        mine[group] = True
        if not i:  # contexts of no shard are scored with the first group
            mine[[s for s in range(len(mine)) if s not in {s for g in groups for s in g}]] = True
        d, seen, p, rest = _arrays(states if len(groups) == 1 else states.filter(F.col("shard").isin(group)), "d", "seen", "p", "rest")
        levels = list(top.levels)
        for level in range(LOW + 1, depth + 1):
            at = np.flatnonzero(d == level)
            at = at[np.argsort(seen[at].view(np.uint64))]
            levels.append(Level(seen[at].view(np.uint64), p[at], rest[at]))
        yield Tree(depth, top.root, levels), mine


def log10_probability(tree: Tree, mine: np.ndarray, depth: int, texts: pa.Array) -> np.ndarray:
    """Of each whole text, its end included: of the bytes whose contexts are ``mine``."""
    key, begins = windows(texts, depth)
    value = np.zeros(len(key))
    own = mine[_context(key, LOW, depth).astype(np.int64)]
    if own.all():
        value = tree.log10(key)
    elif own.any():
        value[own] = tree.log10(key[own])
    return np.add.reduceat(value, begins)


# -- documents


def _partial(batches: Iterator[pa.RecordBatch], tree: Tree, mine: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """own, part: what the contexts of one further group add to each text."""
    for batch in batches:
        for a, b in _text_slices(batch["text"], 2 << 20):
            value = log10_probability(tree, mine, depth, batch["text"].slice(a, b - a))
            yield pa.RecordBatch.from_arrays([batch["own"].slice(a, b - a), pa.array(value)], ["own", "part"])


def _chunks(batches: Iterator[pa.RecordBatch], tree: Tree, mine: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of documents; see CHUNKS."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    most = 0

    def row() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        texts = table["text"].chunk(0)
        codes, distinct, begins = words(texts, byte_table(lower=True))
        score = []
        for a, b in _text_slices(texts, 2 << 20):
            score.append(log10_probability(tree, mine, depth, texts.slice(a, b - a)))
        owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(begins))
        pair, times = np.unique(owner * max(1, len(distinct)) + codes, return_counts=True)
        doc, code = pair // max(1, len(distinct)), pair % max(1, len(distinct))
        held_out = table["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        train = np.bincount(code, times * ~held_out[doc], len(distinct)).astype(np.int64)
        values = [
            (part << 32) | seq, table["doc_id"].to_pylist(), held_out.tolist(), (np.diff(begins) + 1).tolist(), np.concatenate(score).tolist(),
            doc.astype("<i4").tobytes(), code.astype("<i4").tobytes(), times.astype("<i4").tobytes(), table["own"].to_pylist(), distinct.to_pylist(), train.tolist(),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, CHUNKS)], [n for n, _ in CHUNKS])

    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in slices(size + 8, CHUNK // 4):
            held.append(batch.slice(a, b - a))
            most += int(size[a:b].sum()) + 8 * (b - a)
            if most >= CHUNK:
                yield row()
                held, most, seq = [], 0, seq + 1
    if held:
        yield row()


CHUNKS = [
    ("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())),
    ("score", pa.list_(pa.float64())), ("doc", pa.binary()), ("code", pa.binary()), ("times", pa.binary()), ("own", pa.list_(pa.int64())),
    ("word", pa.list_(pa.string())), ("train", pa.list_(pa.int64())),
]
CHUNKS_SQL = (
    "chunk long, doc_id array<long>, held_out array<boolean>, n_tokens array<long>, score array<double>, "
    "doc binary, code binary, times binary, own array<long>, word array<string>, train array<long>"
)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, own long"


def with_base(chunk: pa.Table, counts: pa.Table, tokens: int, distinct: int, ends: int) -> pa.Table:
    """The result rows of one chunk; counts: code and training count of the words that have one."""
    r = chunk.to_pylist()[0]
    doc, code, times = (np.frombuffer(r[c], "<i4") for c in ("doc", "code", "times"))
    n = len(r["doc_id"])
    c = np.zeros(int(code.max(initial=-1)) + 1, dtype=np.int64)
    c[counts["code"].to_numpy()] = counts["c"].to_numpy()
    known = np.bincount(doc, times * (c[code] > 0), n).astype(np.int64) + (ends > 0)
    size = np.array(r["n_tokens"], dtype=np.int64)
    base = np.bincount(doc, times * np.log10(c[code] + 1.0), n) + np.log10(ends + 1.0) - size * np.log10(tokens + distinct + 1.0)
    columns = [
        pa.array(r["doc_id"], pa.int64()), pa.array(r["held_out"], pa.bool_()), pa.array(size), pa.array(known),
        pa.array(np.full(n, tokens, dtype=np.int64)), pa.array(base), pa.array(r["score"], pa.float64()), pa.array(r["own"], pa.int64()),
    ]
    return pa.Table.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])


def score(docs: DataFrame, depth: int = DEPTH, parts: int = 7, out: int = 2, most: int | None = None) -> DataFrame:
    """Learn from documents whose crc32(doc_id as text) mod ``parts`` is not ``out``; score all."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (doc_fold("doc_id", parts) == out).alias("held_out"), F.col("text").cast("string").alias("text")
    ).withColumn("own", F.xxhash64("doc_id", "text"))
    further = None
    for number, (tree, mine) in enumerate(trees(*fit(rows.filter(~F.col("held_out")), depth), depth, MOST_ROWS if most is None else most)):
        shared = spark.sparkContext.broadcast((tree, mine))
        if not number:
            packed = written(rows.mapInArrow(lambda it, s=shared: _chunks(it, *s.value, depth), CHUNKS_SQL), "suffix-chunks", "zstd")
        else:  # repeated rows have the same part
            part = rows.select("own", "text").mapInArrow(lambda it, s=shared: _partial(it, *s.value, depth), "own long, part double")
            part = written(part.groupBy("own").agg(F.max("part").alias("part")), "suffix-parts")
            further = part if further is None else further.unionByName(part)
        shared.unpersist()
    listed = packed.select(F.col("chunk").alias("at"), F.posexplode(F.arrays_zip("word", "train")).alias("code", "w")).select("at", "code", "w.word", "w.train")
    counts = written(listed.groupBy("word").agg(F.sum("train").alias("c"), F.count("*").alias("n")).filter("c > 0"), "suffix-words")
    total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    ends = packed.select(F.explode("held_out").alias("h")).filter("not h").count()
    tokens, distinct = total[1] + ends, total[0] + (ends > 0)
    found = even_join(listed.select("at", "code", "word"), counts, "word", hub=HUB).select("at", "code", "c")
    both = packed.drop("word", "train").groupBy("chunk").cogroup(found.groupBy("at"))
    made = both.applyInArrow(lambda a, b: with_base(a, b, tokens, distinct, ends), RESULT)
    if further is not None:
        added = further.groupBy("own").agg(F.sum("part").alias("part"))
        made = made.join(added, "own", "left").withColumn("score", F.col("score") + F.coalesce("part", F.lit(0.0)))
    return made.drop("own", "part")
