"""Operator 7: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 bits over three-word shingles; two documents link if their
fingerprints differ in at most ``max_bits`` (0 to 2) bits.

Search, on the distinct fingerprints only, so that exact copies never meet:

1. Plan. From a bounded sample of fingerprints, bits are grouped so that
   correlated bits share a partition; for m partitions the thresholds t_i
   (-1: not probed) with sum max_bits - m + 1 are chosen by dynamic programming
   on the estimated number of candidates and probes. The sample only steers cost.
2. Probe. Every fingerprint is filed under each partition's own bits and probed
   under all values within t_i flips. Buckets are verified in vectors and give a
   spanning forest of their links, not pairs.
3. Hot buckets, of more than ``HOT`` rows, are set aside and their fingerprints filed
   again under finer partitions: two words within 2 bits agree in all but 2 of 8 groups
   of correlated bits, so that each is filed under 28 keys of 48 bits; what is still
   hot, under 120 keys of 14 of 16 groups, where no key has more than 256 fingerprints.
   Nothing is cut, and each level is exact for what it takes over.
4. Components by alternating large-star and small-star steps on the links.

Null and empty texts have fingerprint 0 and link like any other; texts of fewer words
than a shingle are one shingle. Rows without a doc_id belong to the component of their
fingerprint, null if no row of it has an id. Repeated rows share fingerprint and
component. Long texts are taken whole. An empty table gives no rows. Columns beyond
doc_id and text are carried by ``keep_one`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import carried, even_join, new_path, removed, sized, stored, written
from pagemill.llm.tokens import slices

SEED = 42
HOT = 4096
SAMPLE = 2048
BITS = 64
#: Bits in which the fingerprints of near copies over two and over five words may differ.
WIDE, WIDE_CHECK = 8, 14
#: Near copies of the stage: the least Jaccard similarity of the sets of five-word shingles.
ALIKE, SHINGLE = 0.8, 5
#: What proposes them: bits over five words at most, and equal bands of minima; 1 of 2,800 pairs of exactly 0.8 shares no band.
LOOSE, BANDS, BAND_ROWS = 20, 20, 5
#: Texts of a block: proposed groups of more are compared block by block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Rows of a bucket that are compared in one task; larger ones are compared by pairs of parts.
BUCKET = 100_000
#: What one filed row costs, in pairs compared.
ROW_COST = 400.0


def hashes_of(text: str | None, width: int) -> list[int]:
    """The hashes of a text's shingles in order, repeats included; of fewer words, of the whole; none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
    join = b" ".join
    if len(words) < width:
        return [xxh64_intdigest(join(words), SEED)] if words else []
    return [xxh64_intdigest(join(s), SEED) for s in zip(*(words[k:] for k in range(width)))]


def fingerprints(texts: list[str | None], width: int = 3) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text; 0 for a text without words."""
    return prints_of((hashes_of(t, width) for t in texts), len(texts))


def prints_of(found: Iterable[list[int] | np.ndarray], n: int) -> np.ndarray:
    """The SimHash of each of n lists of hashes."""
    out = np.zeros(n, dtype=np.uint64)
    hashes: list[np.ndarray] = []
    owners: list[int] = []
    starts: list[int] = []
    held = 0

    def settle() -> None:
        if not hashes:
            return
        h = np.concatenate(hashes)
        bounds = np.array([*starts, len(h)], dtype=np.int64)
        # Long texts are summed in pieces: 64 bytes a shingle would not fit at once.
        sums = np.zeros((len(starts), BITS), dtype=np.int64)
        for at in range(0, len(h), 1 << 18):
            to = min(len(h), at + (1 << 18))
            first = int(np.searchsorted(bounds, at, side="right")) - 1
            last = int(np.searchsorted(bounds, to, side="left"))
            cuts = np.maximum(bounds[first:last], at) - at
            bits = np.unpackbits(h[at:to].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
        ones = sums * 2 > np.diff(bounds)[:, None]
        out[owners] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
        hashes.clear(), owners.clear(), starts.clear()

    for i, own in enumerate(found):
        if not len(own):
            continue
        owners.append(i)
        starts.append(held)
        hashes.append(np.array(own, dtype="<u8"))
        held += len(own)
        if held > 1 << 19:
            settle()
            held = 0
    settle()
    return out


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes."""
    return np.unique(np.array(hashes_of(text, width), dtype=np.uint64))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each set of shingles, a hash of the whole set and one of each band of minima."""
    from xxhash import xxh64_intdigest

    whole = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64)
    bands = np.zeros((len(sets), BANDS), dtype=np.uint64)
    some = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS, BAND_ROWS, 2), dtype=np.uint64) | np.uint64(1)
    mix = np.uint64(0x9E3779B97F4A7C15)
    at, most = 0, 1 << 20
    while at < len(some):  # long texts in turn: the sets of a slice are held once more
        to, held = at, 0
        while to < len(some) and (to == at or held + len(sets[some[to]]) <= most):
            held += len(sets[some[to]])
            to += 1
        part = some[at:to]
        h = np.concatenate([sets[i] for i in part])
        starts = np.concatenate(([0], np.cumsum([len(sets[i]) for i in part])[:-1]))
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                acc = np.full(len(part), b, dtype=np.uint64)
                for r in range(BAND_ROWS):
                    x = (h ^ odd[b, r, 1]) * odd[b, r, 0]
                    low = np.minimum.reduceat(x, starts)
                    acc = (acc ^ low) * mix
                    acc ^= acc >> np.uint64(31)
                bands[part, b] = acc
        at = to
    return whole, bands


def _in_parts(rows: DataFrame, make: Callable[[pa.RecordBatch, list[str | None]], list[pa.Array]], schema: str, most: int = 2 << 20) -> DataFrame:
    """make(part, texts) of runs of rows of about ``most`` bytes of text, since hashes take eight bytes a word more than once."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(size + 1, most):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(make(part, part["text"].to_pylist()), names)
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and own, a hash of the text, of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("own", F.xxhash64("text"))


def with_signature(docs: DataFrame) -> DataFrame:
    """doc_id, own (a hash of the text), fingerprints fp and check over two and five words, whole, bands and size (shingles) of every row."""

    def make(part: pa.RecordBatch, texts: list[str | None]) -> list[pa.Array]:
        five = [np.array(hashes_of(t, SHINGLE), dtype=np.uint64) for t in texts]
        check = prints_of(five, len(five))
        whole, bands = signatures([np.unique(h) for h in five])
        flat = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
        prints = [fingerprints(texts, 2), check, whole]
        return [part["doc_id"], part["own"], *(pa.array(x.view(np.int64)) for x in prints), flat, pa.array([len(h) for h in five], pa.int64())]

    return _in_parts(hashed(docs), make, "doc_id long, own long, fp long, check long, whole long, bands array<long>, size long")


def with_fingerprint(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (signed long) of every row; a null text has no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _in_parts(rows, lambda part, texts: [part["doc_id"], pa.array(fingerprints(texts, width).view(np.int64))], "doc_id long, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups; each grows by the bit most correlated with it."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(sample) > 1 else np.zeros((BITS, BITS))
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def flips(bits: list[int], most: int) -> list[int]:
    """Masks of 1 to ``most`` of the bits."""
    return [sum(1 << b for b in some) for k in range(1, most + 1) for some in combinations(bits, k)]


def plan(sample: np.ndarray, n: int, max_bits: int, row_cost: float = 8.0) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, at the least estimated probes and candidates."""
    best, best_cost = [], float("inf")
    for m in range(1, max_bits + 2):
        groups = group_bits(sample, m)
        costs = []
        for bits in groups:
            mask = np.uint64(sum(1 << b for b in bits))
            apart = np.bitwise_count((sample[:, None] ^ sample[None, :]) & mask)
            row = {-1: 0.0}
            for t in range(max_bits + 1):
                keys = sum(comb(len(bits), k) for k in range(t + 1))
                seen = (int((apart <= t).sum()) - len(sample)) / max(1, len(sample) * (len(sample) - 1))
                pairs = 0.5 * float(n) * n * max(seen, keys / 2.0 ** len(bits))
                row[t] = row_cost * n * keys + pairs
            costs.append(row)
        # table: sum of thresholds so far -> (cost, thresholds)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in table.items():
                for t, c in row.items():
                    if cost + c < nxt.get(total + t, (float("inf"), []))[0]:
                        nxt[total + t] = (cost + c, [*chosen, t])
            table = nxt
        cost, chosen = table.get(max_bits - m + 1, (float("inf"), []))
        if cost < best_cost:
            best, best_cost = list(zip(groups, chosen)), cost
    return best


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(run: np.ndarray, fp: np.ndarray, role: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the linked sets of each run of equal keys."""
    n = len(fp)
    label = np.arange(n)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    at = np.arange(n)
    k = 0
    while len(at):
        k += 1
        at = at[at + k < n]
        at = at[run[at + k] == run[at]]
        if not len(at):
            break
        to = at + k
        hit = (np.bitwise_count(fp[at] ^ fp[to]) <= max_bits) & ((role[at] == 0) | (role[to] == 0)) & (label[at] != label[to])
        i, j = at[hit], to[hit]
        if not len(i):
            continue
        left.append(fp[i])
        right.append(fp[j])
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _verified(frames: Iterator[pd.DataFrame], max_bits: int, most: int) -> Iterator[pd.DataFrame]:
    """Links a, b within the runs of equal (part, key) of a sorted partition; runs of more than ``most`` rows give their fingerprints as ``hot`` instead."""

    def links(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        part, key, fp = frame["part"].to_numpy(), frame["key"].to_numpy(), frame["fp"].to_numpy()
        new = np.ones(len(frame), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        hot = np.repeat(np.diff(np.append(starts, len(frame))) > most, np.diff(np.append(starts, len(frame))))
        if hot.any():
            yield told(hot=np.unique(fp[hot]))
        cold = ~hot
        a, b = _forest(np.cumsum(new)[cold], fp[cold].view(np.uint64), frame["role"].to_numpy()[cold], max_bits)
        yield told(a.view(np.int64), b.view(np.int64))

    def told(a: np.ndarray | None = None, b: np.ndarray | None = None, hot: np.ndarray | None = None) -> pd.DataFrame:
        n = len(a if hot is None else hot)
        made = {"a": a, "b": b, "hot": hot}
        return pd.DataFrame({c: pd.array([None] * n if v is None else v, dtype="Int64") for c, v in made.items()})

    held: pd.DataFrame | None = None
    hot_key: tuple[int, int] | None = None  # of a run so large that it is handed on as it comes
    for frame in frames:
        if hot_key is not None:
            inside = ((frame["part"] == hot_key[0]) & (frame["key"] == hot_key[1])).to_numpy()
            if inside.any():
                yield told(hot=np.unique(frame["fp"].to_numpy()[inside]))
            frame = frame[~inside]
        if not len(frame):
            continue
        hot_key = None
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        end = (int(frame["part"].iat[-1]), int(frame["key"].iat[-1]))
        last = ((frame["part"] == end[0]) & (frame["key"] == end[1])).to_numpy()
        cut = int(np.argmax(last))
        if cut:
            yield from links(frame.iloc[:cut].reset_index(drop=True))
        held = frame.iloc[cut:].reset_index(drop=True)
        if len(held) > most:
            yield told(hot=np.unique(held["fp"].to_numpy()))
            held, hot_key = None, end
    if held is not None and len(held):
        yield from links(held)


def exact_masks(sample: np.ndarray, groups: int, max_bits: int) -> list[int]:
    """Masks such that words within ``max_bits`` agree under at least one: all groups of correlated bits but ``max_bits``."""
    made = [sum(1 << b for b in bits) for bits in group_bits(sample, groups)]
    return [sum(some) for some in combinations(made, groups - max_bits)]


def near(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links a, b that join all fingerprints (column fp, distinct) within ``max_bits``."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    none = distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if max_bits == 0:
        return none
    n = distinct.count()
    if n < 2:
        return none
    rows = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    sample = np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64)
    # Each level: (mask, flip, role) of the keys; the last has no key of more than 2**(64/16*2) words.
    levels = [[(sum(1 << b for b in bits), x, int(x != 0)) for bits, threshold in plan(sample, n, max_bits) if threshold >= 0 for x in (0, *flips(bits, threshold))]]
    levels += [[(mask, 0, 0) for mask in exact_masks(sample, groups, max_bits)] for groups in (8, 16)]
    links = none
    for depth, level in enumerate(levels):
        number = {m: i for i, m in enumerate(dict.fromkeys(m for m, _, _ in level))}
        keys = [F.struct(F.lit(number[m]).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).bitwiseXOR(F.lit(_signed(x))).alias("key"), F.lit(role).alias("role")) for m, x, role in level]
        filed = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.part", "k.key", "fp", "k.role")
        runs = filed.repartition("part", "key").sortWithinPartitions("part", "key", "fp")
        most = HOT if depth + 1 < len(levels) else 1 << 30
        told = written(runs.mapInPandas(lambda it, most=most: _verified(it, max_bits, most), "a long, b long, hot long"), "simhash-links")
        links = links.unionByName(told.filter("a is not null").select("a", "b"))
        distinct = told.filter("hot is not null").select(F.col("hot").alias("fp")).distinct()
        if depth + 1 == len(levels) or distinct.isEmpty():
            break
        distinct = written(distinct, "simhash-hot")
    return links


def _stars(bucket: np.ndarray, ids: np.ndarray, fp: np.ndarray, check: np.ndarray, role: np.ndarray, most: int, most_check: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the linked sets of each bucket. Rows are sorted by bucket and role; the filed (role 0) come first.

    Every filed row is compared with all rows of its bucket that are not linked to it yet.
    """
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.append(starts, len(bucket)))
    filed = np.add.reduceat((role == 0).astype(np.int64), starts)
    own = np.repeat(np.arange(len(starts)), size)
    rows = np.flatnonzero((filed[own] > 0) & (size[own] > 1))
    label = np.arange(len(bucket))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    turn = 0
    while len(rows := rows[filed[own[rows]] > turn]):
        at = starts[own[rows]] + turn
        apart = label[rows] != label[at]
        i, j = at[apart], rows[apart]
        hit = (np.bitwise_count(fp[i] ^ fp[j]) <= most) & (np.bitwise_count(check[i] ^ check[j]) <= most_check)
        i, j = i[hit], j[hit]
        turn += 1
        if not len(i):
            continue
        left.append(ids[i])
        right.append(ids[j])
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def compared(filed: DataFrame, max_bits: int, max_check: int) -> DataFrame:
    """Links a, b that span what the rows (bucket, id, fp, check, role) of each bucket join.

    Buckets of more than BUCKET rows are only named by the first pass. Their rows are dealt
    into parts, and every pair of parts is compared in a task of its own.
    """
    told = written(_bucketed(filed, max_bits, max_check, BUCKET), "near-links")
    links = told.filter("a is not null").select("a", "b")
    hot = told.filter("hot is not null").groupBy(F.col("hot").alias("bucket")).agg(F.sum("n").alias("n"))
    hot = written(hot, "near-hot")
    if hot.isEmpty():
        return links
    # At most rows / BUCKET buckets are hot; checked all the same.
    rows = filed.join(sized(hot), "bucket")
    parts = F.ceil(F.col("n") / F.lit(BUCKET // 2)).cast("long")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", F.lit(SEED)), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(pair.alias("bucket"), "id", "fp", "check", "role")
    return links.unionByName(_bucketed(rows, max_bits, max_check, 1 << 40).filter("a is not null").select("a", "b"))


def _bucketed(filed: DataFrame, max_bits: int, max_check: int, most: int) -> DataFrame:
    """a, b of links; or hot, n: a bucket of more than ``most`` rows and how many of them these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count, hot = 0, None

        def told(a=(), b=(), bucket=(), n=()) -> pa.RecordBatch:
            size = max(len(a), len(bucket))
            columns = [pa.array(x, pa.int64()) if len(x) == size else pa.nulls(size, pa.int64()) for x in (a, b, bucket, n)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "hot", "n"])

        def links(to_end: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            columns = [np.concatenate(c) for c in zip(*held)]
            cut = len(columns[0]) if to_end else int(np.searchsorted(columns[0], columns[0][-1]))
            held = [[c[cut:] for c in columns]]
            count = len(columns[0]) - cut
            columns = [c[:cut] for c in columns]
            if cut:
                names, size = np.unique(columns[0], return_counts=True)
                if (size > most).any():
                    yield told(bucket=names[size > most], n=size[size > most])
                    own = np.repeat(size <= most, size)
                    columns = [c[own] for c in columns]
                if len(columns[0]):
                    bucket, ids, fp, check, role = columns
                    yield told(*_stars(bucket, ids, fp.view(np.uint64), check.view(np.uint64), role, max_bits, max_check))

        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in range(5)]
            if hot is not None:  # the rest of a bucket that is known to be hot
                own = rows[0] == hot
                if own.any():
                    yield told(bucket=[hot], n=[int(own.sum())])
                    rows = [c[~own] for c in rows]
            if not len(rows[0]):
                continue
            hot = None
            held.append(rows)
            count += len(rows[0])
            if count < max(300_000, most if most < 1 << 40 else 0):
                continue
            if held[-1][0][-1] != held[0][0][0]:
                yield from links(False)
            elif count > most:
                hot = int(rows[0][-1])
                yield told(bucket=[hot], n=[count])
                held, count = [], 0
        if count:
            yield from links(True)

    return filed.repartition("bucket").sortWithinPartitions("bucket", "role", "id").mapInArrow(run, "a long, b long, hot long, n long")


def near_copies(nodes: DataFrame, max_bits: int = WIDE, max_check: int = WIDE_CHECK) -> DataFrame:
    """Links a, b that join all nodes (id, fp, check) whose fp differ in ``max_bits`` and check in ``max_check`` bits at most."""
    n = nodes.count()
    rows = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    if n < 2:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    entries = []
    for number, (bits, threshold) in enumerate(plan(np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64), n, max_bits, ROW_COST)):
        if threshold >= 0:
            mask = _signed(sum(1 << b for b in bits))
            entries += [(number, mask, _signed(x), int(x != 0)) for x in (0, *flips(bits, threshold))]
    lit = lambda e: F.struct(F.lit(e[0]).alias("part"), F.lit(e[1]).cast("long").alias("mask"), F.lit(e[2]).cast("long").alias("flip"), F.lit(e[3]).alias("role"))
    filed = nodes.select("id", "fp", "check", F.explode(F.array(*map(lit, entries))).alias("k"))
    key = F.col("fp").bitwiseAND(F.col("k.mask")).bitwiseXOR(F.col("k.flip"))
    filed = filed.select(F.xxhash64("k.part", key).alias("bucket"), "id", "fp", "check", F.col("k.role").alias("role"))
    return compared(filed, max_bits, max_check)


def proposed(nodes: DataFrame) -> DataFrame:
    """Links a, b that join all nodes (id, fp, check, bands) that may be near copies: by fingerprints, or by a band of minima.

    Fingerprints over two words are near for edits of words; a passage put in, out or at
    the end takes more bits than they can be searched by, and is found by the bands.
    """
    banded = nodes.select(F.posexplode("bands").alias("part", "band"), "id", "fp", "check")
    banded = banded.select(F.xxhash64("part", "band").alias("bucket"), "id", "fp", "check", F.lit(0).alias("role"))
    return near_copies(nodes, WIDE, LOOSE).unionByName(compared(banded, BITS, LOOSE))


def alike(ids: np.ndarray, sets: list[np.ndarray], least: float = ALIKE) -> tuple[np.ndarray, np.ndarray]:
    """Links that span all sets joined by pairs of a Jaccard similarity of ``least`` or more; all pairs are compared."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(size)
    label = np.arange(len(sets))
    if len(full) > 1:
        names, codes = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(size[full])[:-1]))
        mark = np.zeros(len(names), dtype=np.int64)
        for k, i in enumerate(full):
            rest = np.flatnonzero(label[full] != label[i])  # sets that are linked already need no comparing
            rest = rest[size[full[rest]] * least <= size[i] + 1e-9]
            rest = rest[size[full[rest]] >= least * size[i] - 1e-9]
            if not len(rest):
                continue
            own, others = codes[starts[k] : starts[k] + size[i]], full[rest]
            mark[own] = 1
            at = np.repeat(starts[rest] - np.concatenate(([0], np.cumsum(size[others])[:-1])), size[others]) + np.arange(size[others].sum())
            both = np.add.reduceat(mark[codes[at]], np.concatenate(([0], np.cumsum(size[others])[:-1])))
            mark[own] = 0
            hit = np.append(others[both >= least * (size[i] + size[others] - both) - 1e-9], i)
            joined = np.unique(label[hit])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    below = np.flatnonzero(label != np.arange(len(sets)))
    return ids[label[below]], ids[below]


def verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links a, b that join the near copies within each proposed group; members: doc_id, own, node, root, size.

    Groups of more than BLOCK texts, or of many long ones, are compared by pairs of blocks, so that no group falls to one task.
    """
    # A row for each group of more than one block; texts move only where a group asks for them.
    parts = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES))).cast("long")
    large = sized(written(members.groupBy("root").agg(parts.alias("n")).filter("n > 1"), "large-groups"))
    rows = hashed(docs).join(sized(members.drop("size")), ["doc_id", "own"]).join(large, "root", "left")
    blocks = F.coalesce(F.col("n"), F.lit(1).cast("long"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(SEED)), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("node", "text", "root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node")  # a text whose row repeats
        a, b = alike(frame["node"].to_numpy(), [shingles(t) for t in frame["text"]])
        return pd.DataFrame({"a": a, "b": b})

    return rows.groupBy("root", "x", "y").applyInPandas(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of every node of links a, b of longs."""
    spark = links.sparkSession
    path = new_path(spark, "links")
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), path)

    def stamp(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = stamp(edges)
    while True:
        done = []

        def kept(df: DataFrame) -> DataFrame:
            done.append(new_path(spark, "links"))
            return stored(df, done[-1])

        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        large = even_join(both, least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = kept(large.filter("a <> b"))
        low = kept(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = even_join(large, low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        last, path = path, new_path(spark, "links")
        edges = stored(small.select("e.a", "e.b").filter("a <> b").distinct(), path)
        after = stamp(edges)
        for old in (last, *done):
            removed(spark, old)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def clusters(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """fp, component, n (its rows) of the fingerprints that more than one document shares or that have links."""
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    roots = components(near(groups.select("fp"), max_bits))
    linked = written(roots.join(groups, roots.node == groups.fp).select("fp", "root", "least", F.col("n").alias("rows")), "linked")
    named = written(linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("n")), "named")
    linked = even_join(linked, named, "root").select("fp", "component", F.col("rows").alias("n"))
    copies = groups.filter("n > 1").select("fp", F.col("least").alias("component"), "n")
    both = copies.unionByName(linked).groupBy("fp").agg(F.min("component").alias("component"), F.max("n").alias("n"))
    return written(both, "clusters")


def near_duplicates(docs: DataFrame, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of ``docs``.

    A row with a null doc_id gets the component of its fingerprint, null if no
    row of the component has an id. Repeated rows share a component.
    """
    prints = written(with_fingerprint(docs), "fp")
    found = clusters(prints, max_bits)
    return even_join(prints, found, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


@carried
def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its group of near copies, once each.

    A doc_id that repeats with texts that are no near copies keeps each of them.

    Two texts are near copies if the sets of their five-word shingles have a Jaccard
    similarity of ``ALIKE`` or more. Fingerprints and bands only propose pairs; all texts of
    what they join are compared by their shingles. Groups are what near copies join.
    Rows without a doc_id cannot be named as representatives: they stay.
    """
    named = docs.filter("doc_id is not null")
    prints = written(with_signature(named), "fp")
    same = ["fp", "check", "whole"]
    groups = prints.groupBy(*same).agg(F.min(F.struct("doc_id", "own")).alias("least"), F.max("size").alias("size"), F.first("bands").alias("bands"))
    groups = written(groups.withColumn("id", F.xxhash64(*same)), "prints")
    near_ = components(proposed(groups))
    members = written(near_.join(groups.select(F.col("id").alias("node"), "least", "size"), "node").select("least.*", "node", "root", "size"), "proposed")
    roots = components(verified(named, members))
    linked = written(roots.join(groups.select(F.col("id").alias("node"), "least"), "node").select("node", "root", "least"), "linked")
    # Who is not the least of his group goes: as a copy by its shingles, or as a node whose group has a lesser.
    first = written(linked.groupBy("root").agg(F.min_by("node", F.struct("least", "node")).alias("keeps"), F.count("*").alias("n")), "first")
    gone = even_join(linked, first, "root").filter("node <> keeps").select(F.col("node").alias("id"))
    stays = groups.join(gone, "id", "left_anti").select("least.*", F.lit(True).alias("stays"))
    # Rows that go, and rows that repeat and of which one stays: keys of two numbers, so that texts need not move.
    keys = prints.groupBy("doc_id", "own").agg(F.count("*").alias("n")).join(stays, ["doc_id", "own"], "left")
    odd = written(keys.filter("stays is null or n > 1").select(F.col("doc_id").alias("__id"), F.col("own").alias("__own"), F.col("n").alias("__n"), F.col("stays").alias("__stays")), "odd-rows")
    same_row = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__own"))
    out = named.join(sized(odd), same_row, "left_anti")
    twice = odd.filter("__stays")
    if not twice.isEmpty():
        nth = F.row_number().over(Window.partitionBy("__id", "__own").orderBy(F.lit(0)))
        out = out.unionByName(named.join(sized(twice), same_row).withColumn("__nth", nth).filter("__nth = 1").select(*docs.columns))
    return out.unionByName(docs.filter("doc_id is null"))
