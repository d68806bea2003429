"""Operator 8: token ids as directly addressable codes (DACs).

File format. The corpus is a sequence of ids cut into segments, each a
self-contained blob that covers consecutive documents in ascending doc_id
order. A segment holds

    magic  "DAC1"
    u32    number of levels L
    L x    { u64 n_l, u8 width_l in bytes,
             n_l chunks of width_l bytes, little endian,
             ceil(n_l / 64) u64 words of the continuation bitmap,
             ceil(n_l / 512) + 1 u64 entries of the rank directory }

Level 0 has one chunk for every id: its low 8 bits. The continuation bit says
that higher bits follow at level 1, at the position given by rank(bitmap, i).
The rank directory holds the number of set bits before every 512th position,
so that one id is read with at most L directory look-ups and 8 popcounts,
without decoding its neighbours.

Segments are rows of a Parquet table (column ``payload``), because Spark's
committer is the one writer that works on every shared store and survives lost
executors; ``doc_ids`` and ``lengths`` list the documents of a segment, and
``segment`` gives the order. ``before`` counts the ids of earlier segments of the same
part; a part is a range of documents that one task wrote, so that ``layout()`` needs the
totals of the parts only, a row for each task of the write, to give global starts.

A null or empty text has only the end id. Null doc_ids come first. Rows of one id are
ordered by a hash of their text and then by text; repeated rows are all kept and have the
same ids. An empty table writes no segment and gives no rows. Long texts are encoded
whole. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import new_path

MAGIC = b"DAC1"
BLOCK = 512
#: A segment is closed once it has so many ids; a slice of 8 MB of text may add to that.
SEGMENT_IDS = 1 << 21
WIDTHS = (1, 1, 2)
SEGMENT_SCHEMA = (
    "segment long, part int, seq int, before long, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"
)


def pack(ids: np.ndarray) -> bytes:
    """One DAC blob of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    out: list[bytes] = []
    levels = 0
    while levels == 0 or len(rest):
        width = WIDTHS[min(levels, len(WIDTHS) - 1)]
        chunk = (rest & np.uint32((1 << (8 * width)) - 1)).astype(f"<u{width}")
        more = rest >> np.uint32(8 * width)
        bits = more != 0
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros((len(rest) + 63) // 64 * 8, dtype=np.uint8)
        words[: len(packed)] = packed
        per_block = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64) if len(bits) else []
        ranks = np.concatenate(([0], np.cumsum(per_block))).astype("<u8")
        out.append(struct.pack("<QB", len(rest), width) + chunk.tobytes() + words.tobytes() + ranks.tobytes())
        rest = more[bits]
        levels += 1
    return MAGIC + struct.pack("<I", levels) + b"".join(out)


class Reader:
    """Random access to the ids of one blob."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        (levels,) = struct.unpack_from("<I", blob, 4)
        at, self.levels = 8, []
        for _ in range(levels):
            n, width = struct.unpack_from("<QB", blob, at)
            at += 9
            chunks = np.frombuffer(blob, f"<u{width}", n, at)
            at += n * width
            words = np.frombuffer(blob, "<u8", (n + 63) // 64, at)
            at += words.nbytes
            ranks = np.frombuffer(blob, "<u8", (n + BLOCK - 1) // BLOCK + 1, at)
            at += ranks.nbytes
            self.levels.append((n, width, chunks, words, ranks))

    def __len__(self) -> int:
        return self.levels[0][0]

    def __getitem__(self, i: int) -> int:
        """The i-th id, from one chunk a level and one rank between levels."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for _, width, chunks, words, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not (int(words[i >> 6]) >> (i & 63)) & 1:
                return value
            first = i // BLOCK * (BLOCK // 64)
            before = sum(int(w).bit_count() for w in words[first : i >> 6])
            within = int(words[i >> 6]) & ((1 << (i & 63)) - 1)
            i = int(ranks[i // BLOCK]) + before + within.bit_count()
            shift += 8 * width
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level from the last."""
        upper = np.zeros(0, dtype=np.uint32)
        for n, width, chunks, words, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            bits = np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)
            if len(upper):
                value[bits] |= upper << np.uint32(8 * width)
            upper = value
        return upper


#: A run of Latin letters that stay letters when lower-cased and composed (İ does not: it leaves a mark),
#: then plain punctuation: the tokenizer always splits between the two.
MARKS = "[\u0300-\u036f]"
#: The first bytes that a mark may have.
MARK_LEADS = (b"\xcc", b"\xcd")
STEM = re.compile("([a-zÀ-ÖØ-öø-įı-ƿ]+)([.,!&$%#*|?;:]+)")


class ChunkCoder:
    """Texts -> their ids; what recurs is encoded once and kept.

    The tokenizer drops white space before it splits, so that the ids of a text
    are those of its blank-free chunks in order. Arrow splits a batch and numbers
    its distinct chunks; a chunk of letters and closing punctuation is the sum of
    both, so that many chunks share a stem. A-Z are lower-cased by the tokenizer
    in any case, and here where no mark follows. Texts that may hold a special token, in whatever case, are encoded whole.
    Both tables start afresh when they are full, which bounds memory and changes no result.
    """

    def __init__(self, path: str, chunks: int = 200_000, stems: int = 450_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_chunks, self.most_stems = chunks, stems
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def learn_words(self, words: list[str]) -> list[str]:
        """Words of letters, many in one text: each has exactly one piece that ends a word.

        Returns those of texts where the count of such pieces differs from that of words.
        """
        groups = [words[at : at + 500] for at in range(0, len(words), 500)]
        odd: list[str] = []
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                odd += group
                continue
            blob, cuts = ids.tobytes(), (4 * cuts).tolist()
            self.stems.update(zip(group, [blob[a:b] for a, b in zip([0, *cuts], cuts)]))
        return odd

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        match = STEM.fullmatch
        parts = [m.groups() if (m := match(x)) else (x,) for x in chunks]
        need = set().union(*parts)
        if len(self.stems) + len(need) > self.most_stems:
            self.stems = {}
        else:
            need.difference_update(self.stems)
        stems = self.stems
        words = [x for x in need if x.isalpha()]
        rest = [x for x in need if not x.isalpha()]
        for at in range(0, len(words), 20_000):
            rest += self.learn_words(words[at : at + 20_000])
        for at in range(0, len(rest), 5_000):
            some = rest[at : at + 5_000]
            for stem, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                stems[stem] = array("I", got.ids).tobytes()
        return {c: stems[p[0]] if len(p) == 1 else stems[p[0]] + stems[p[1]] for c, p in zip(chunks, parts)}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of each text's ids."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), dtype=bool)
        if any(pc.any(pc.match_substring(texts, content[:2])).as_py() for content in {c[:2] for c in self.special}):
            for content in self.special:
                whole |= pc.match_substring(texts, content, ignore_case=True).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.encode_chunks(texts)
        ids, size = self.encode_chunks(pc.if_else(pa.array(whole), "", texts))
        parts = np.split(ids, np.cumsum(size)[:-1])
        for i in np.flatnonzero(whole):
            parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
        return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)

    def encode_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts without special tokens."""
        # A capital and a mark may compose otherwise than its small letter does: such texts are left to the tokenizer.
        low = pc.ascii_lower(texts)
        data = texts.buffers()[2]
        if data is not None and any(lead in memoryview(data).tobytes() for lead in MARK_LEADS):
            low = pc.if_else(pc.match_substring_regex(texts, MARKS), texts, low)
        for blank in "\n\t\r":
            low = pc.replace_substring(low, blank, " ")
        split = pc.split_pattern(low, " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        get = self.chunks.get
        values = list(map(get, distinct))
        new = [c for c, v in zip(distinct, values) if v is None]
        if new:
            if len(self.chunks) + len(new) > self.most_chunks:
                self.chunks = {}
            found = self.learn(new)
            values = [found[c] if v is None else v for c, v in zip(distinct, values)]
            if len(found) <= self.most_chunks:
                self.chunks.update(found)
        flat = np.frombuffer(b"".join(values), dtype=np.uint32)
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        start = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        long = size[which]
        ends = np.cumsum(long)
        at = np.repeat((start[which] - (ends - long)).astype(np.int32), long)
        at += np.arange(len(at), dtype=np.int32)
        ids = flat[at]
        cuts = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(cuts)


_CODERS: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    if path not in _CODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        _CODERS[path] = ChunkCoder(path)
    return _CODERS[path]


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(size // most)) + 1 if len(size) else []
    at = 0
    for to in [*cuts, batch.num_rows]:
        yield batch.slice(at, to - at)
        at = to


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    code = coder(path)
    part = TaskContext.get().partitionId()
    docs: list[int | None] = []
    lengths: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    held = seq = before = 0

    def flush() -> pa.RecordBatch:
        row = [[(part << 32) | seq], [part], [seq], [before], [docs], [np.concatenate(lengths).tolist()], [held], [pack(np.concatenate(ids))]]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        names = ["segment", "part", "seq", "before", "doc_ids", "lengths", "n_ids", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names)

    for batch in batches:
        for piece in _pieces(batch, 8 << 20):
            if not piece.num_rows:
                continue
            got, size = code.encode(piece["text"])
            withend = np.insert(got, np.cumsum(size), np.uint32(end_id))
            docs += piece["doc_id"].to_pylist()
            lengths.append(size + 1)
            ids.append(withend)
            held += len(withend)
            if held >= limit:
                yield flush()
                docs, lengths, ids, before, held, seq = [], [], [], before + held, 0, seq + 1
    if docs:
        yield flush()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, limit: int = SEGMENT_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the segments under ``path``.

    Range partitions follow doc_id, so one shuffle of the texts gives the order;
    a partition writes its segments as it reads, holding one of them in memory.
    Rows of one id are spread by a hash of their text. Returns the table of segments.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Without further keys, repeated ids would have no defined order.
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("text").asc_nulls_first())
    ranged.mapInArrow(lambda it: _segments(it, tokenizer, end_id, limit), SEGMENT_SCHEMA).write.mode(
        "overwrite"
    ).option("compression", "none").option("parquet.block.size", str(16 << 20)).parquet(path)
    return spark.read.parquet(path)


def layout(segments: DataFrame) -> DataFrame:
    """part, start: ids of all parts before it. One row for each task of the write."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))


def placed(segments: DataFrame) -> DataFrame:
    """``segments`` with first, the ids of all segments before each."""
    return segments.join(F.broadcast(layout(segments)), "part").withColumn("first", F.col("start") + F.col("before"))


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples(index=False):
            ids = Reader(row.payload).all().astype("<u4")
            ends = np.cumsum(np.asarray(row.lengths, dtype=np.int64))
            starts = ends - np.asarray(row.lengths, dtype=np.int64)
            yield pd.DataFrame({
                "doc_id": pd.array(list(row.doc_ids), dtype="Int64"),
                "start": starts + row.first,
                "n_tokens": ends - starts,
                "ids_crc32": np.fromiter((zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)), np.int64, len(ends)),
            })


def read_tokens(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    return placed(segments).select("doc_ids", "lengths", "payload", "first").mapInPandas(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(segments: DataFrame, position: int) -> int:
    """The id at a position of the whole corpus, by random access into one segment."""
    at = placed(segments).filter((F.col("first") <= position) & (F.col("first") + F.col("n_ids") > position))
    row = at.select("payload", "first").first()
    if row is None:
        raise IndexError(position)
    return Reader(bytes(row["payload"]))[position - row["first"]]


def roundtrip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    segments = write_tokens(docs, new_path(docs.sparkSession, "dac"), tokenizer, end_id)
    return read_tokens(segments)
