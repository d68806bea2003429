"""Operator 4: quality rules by distribution divergence.

A document is rejected by base rules (too few words, too much repetition), or if
its histogram of character classes or of common words is too far, by
Jensen-Shannon distance (the root of the divergence in bits), from its language's
reference. Common words, the ``SIZE`` most frequent words of letters of each language,
and references are learned from all documents that pass the base rules. Short texts
scatter: limits widen with the root of the inverse length, and texts under
``Limits.min_words`` words are not judged by them.

A null or empty text has no words. A document without a lang is compared with the
language whose common words it holds most of, the first by name of equals; if it holds
none, or no document of its language passes the base rules, only the base rules apply.
Repeated rows are judged alike and learned from as often as they occur; equally frequent
words come in the order of their bytes. Long texts are read whole. An empty table gives
no rows. Columns beyond doc_id, text and lang are carried by ``keep_good``, whatever
their names, and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import carried, written
from pagemill.llm.tokens import byte_table, mapped, raw_bytes, slices, words

SIZE = 24
#: a-z, A-Z, 0-9, blank, line end, full stop and comma, ! and ?, symbols of the contract, other ASCII, further characters.
CLASSES = 10
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Distances at most, for a text without end; ``slack`` over the root of the number of words is added in squares."""

    chars: float = 0.15
    chars_slack: float = 1.8
    words: float = 0.235
    words_slack: float = 2.0
    min_words: int = 30


def _classes() -> np.ndarray:
    out = np.full(256, 8, dtype=np.int32)
    out[97:123], out[65:91], out[48:58] = 0, 1, 2
    out[[32, 9, 11, 12, 13]], out[10] = 3, 4
    out[list(b".,")], out[list(b"!?")], out[list(SYMBOLS)] = 5, 6, 7
    out[128:192] = CLASSES  # bytes that continue a character
    out[192:] = 9
    return out


def _repeats(codes: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """Words of each text inside windows of ``span`` words found twice or more in it."""
    n, docs = len(codes), len(starts) - 1
    owner = np.repeat(np.arange(docs), np.diff(starts))
    if n < span:
        return np.zeros(docs, dtype=np.int64)
    key = np.zeros(n - span + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - span + 1 + k].astype(np.uint64) + np.uint64(1)
            key ^= key >> np.uint64(29)
        key += owner[: len(key)].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(owner[: len(key)] == owner[span - 1 :])
    key = key[at]
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    repeated = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + span, -1)
    inside = np.cumsum(cover[:-1]) > 0
    return np.bincount(owner[inside], minlength=docs)


def base_counts(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of every text: the contract's counts, the histogram of classes; and the words as ``words`` has them."""
    codes, distinct, starts = words(texts, byte_table())
    docs = len(texts)
    raw, offsets = raw_bytes(mapped(texts, np.arange(256, dtype=np.uint8)))
    wide = CLASSES + 1
    kinds = np.repeat((np.arange(docs) * wide).astype(np.int32), np.diff(offsets))
    kinds += _classes()[raw]
    hist = np.bincount(kinds, minlength=docs * wide).reshape(docs, wide)[:, :CLASSES]
    lines = ([x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")] for t in pc.fill_null(texts, "").to_pylist())
    made = {
        "n_words": np.diff(starts).astype(np.int64),
        "word_chars": hist.sum(axis=1) - hist[:, 3] - hist[:, 4],
        "n_symbols": hist[:, 7],
        "n_dup_lines": np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, docs),
        "n_repeat_words": _repeats(codes, starts, 8),
    }
    return made, hist, codes, distinct, starts


def common_counts(codes: np.ndarray, distinct: pa.Array, starts: np.ndarray, langs: list[str | None], learned: dict[str, list[str]]) -> tuple[list[str | None], np.ndarray]:
    """The language that each text is compared with, and how often it has each of its common words."""
    docs = len(langs)
    owner = np.repeat(np.arange(docs), np.diff(starts))
    refs = [x if x in learned else None for x in langs]
    out = np.zeros((docs, SIZE), dtype=np.int64)

    def counted(lang: str, rows: np.ndarray) -> np.ndarray:
        """Of the texts that ``rows`` marks."""
        slot = pc.fill_null(pc.index_in(distinct, pa.array(learned[lang], distinct.type)), -1).to_numpy().astype(np.int64)
        own = rows[owner]
        got, at = slot[codes[own]], owner[own]
        return np.bincount(at[got >= 0] * SIZE + got[got >= 0], minlength=docs * SIZE).reshape(docs, SIZE)

    for lang in sorted({x for x in refs if x is not None}):
        rows = np.array([x == lang for x in refs], dtype=bool)
        out[rows] = counted(lang, rows)[rows]
    free = np.array([x is None for x in langs], dtype=bool)
    most = np.zeros(docs, dtype=np.int64)
    if free.any():
        for lang in sorted(learned):
            found = counted(lang, free)
            better = np.flatnonzero(found.sum(axis=1) > most)
            out[better], most[better] = found[better], found[better].sum(axis=1)
            for i in better:
                refs[i] = lang
    return refs, out


FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "ref string, chars array<long>, common array<long>"
)


def _lists(table: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(table.ravel().astype(np.int64)), table.shape[1]).cast(pa.list_(pa.int64()))


def _in_slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    return slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1, most)


def measure(texts: pa.Array, langs: pa.Array, learned: dict[str, list[str]]) -> pa.Array:
    """The counts of every text; see FEATURES."""
    names, some = [x.split()[0] for x in FEATURES.split(", ")], []
    for a, b in _in_slices(texts, 1 << 20):
        made, hist, codes, distinct, starts = base_counts(texts.slice(a, b - a))
        refs, common = common_counts(codes, distinct, starts, langs.slice(a, b - a).to_pylist(), learned)
        some.append(pa.StructArray.from_arrays([*map(pa.array, made.values()), pa.array(refs, pa.string()), _lists(hist), _lists(common)], names))
    return pa.concat_arrays(some) if some else pa.array([], pa.struct([(n, pa.int64()) for n in names[:5]] + [("ref", pa.string())] + [(n, pa.list_(pa.int64())) for n in names[6:]]))


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n: the words of each language in the texts that pass the base rules."""
    for batch in batches:
        for a, b in _in_slices(batch["text"], 2 << 20):
            made, _, codes, distinct, starts = base_counts(batch["text"].slice(a, b - a))
            good = ~_failed(made["n_words"], made["n_repeat_words"])
            owner = np.repeat(np.arange(b - a), np.diff(starts))
            langs = np.array(batch["lang"].slice(a, b - a).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                n = np.bincount(codes[(good & (langs == lang))[owner]], minlength=len(distinct))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), distinct.take(pa.array(at)).cast(pa.string()), pa.array(n[at].astype(np.int64))], ["lang", "word", "n"])
        pa.default_memory_pool().release_unused()


def learned_words(docs: DataFrame) -> dict[str, list[str]]:
    """The most frequent words of letters of each language, over all its documents that pass the base rules. SIZE words a language reach the driver."""
    if "lang" not in docs.columns:
        return {}
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    said = rows.filter("lang is not null and text is not null").mapInArrow(_said, "lang string, word string, n long")
    counts = said.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.rlike("word", F.lit(r"^\p{L}+$")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    found: dict[str, list[str]] = {}
    for r in counts.withColumn("rank", rank).filter(F.col("rank") <= SIZE).orderBy("lang", "rank").collect():
        found.setdefault(r.lang, []).append(r.word)
    return found


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with the struct __q of counts."""
    learned = learned_words(docs)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(text: pa.Array, lang: pa.Array) -> pa.Array:
        return measure(text, lang, learned)

    return docs.withColumn("__q", F.arrow_udf(run, FEATURES)(F.col("text").cast("string"), lang))


def _failed(n_words, n_repeat_words):
    """The base rules, of columns or of arrays."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def base_failed(q: str = "__q") -> Column:
    return _failed(F.col(f"{q}.n_words"), F.col(f"{q}.n_repeat_words"))


def references(features: DataFrame, q: str = "__q") -> dict[str, tuple[list[float], list[float]]]:
    """Language -> histograms of classes and of common words (and the rest), over all documents that pass the base rules.

    One row for each language: what comes to the driver grows with their number only.
    """
    sums = [F.sum(F.col(f"{q}.chars")[i]).alias(f"c{i}") for i in range(CLASSES)]
    sums += [F.sum(F.col(f"{q}.common")[i]).alias(f"w{i}") for i in range(SIZE)]
    passed = features.filter(~base_failed(q) & F.col(f"{q}.ref").isNotNull())
    rows = passed.groupBy(F.col(f"{q}.ref").alias("ref")).agg(F.sum(f"{q}.n_words").alias("n"), *sums).collect()
    out = {}
    for r in rows:
        chars = [r[f"c{i}"] for i in range(CLASSES)]
        common = [r[f"w{i}"] for i in range(SIZE)]
        common.append(r["n"] - sum(common))
        out[r["ref"]] = ([x / max(1, sum(chars)) for x in chars], [x / max(1, sum(common)) for x in common])
    return out


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts from a distribution: the root of the divergence in bits."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    share = F.transform(counts, lambda x: x / total)
    side = lambda x, m: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(share, reference, lambda p, r: side(p, (p + r) / 2) + side(r, (p + r) / 2))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))).otherwise(F.lit(0.0))


def judged(features: DataFrame, found: dict, limits: Limits = Limits(), q: str = "__q") -> DataFrame:
    """Adds base_failed, char_distance, word_distance and kept."""
    rows = [(lang, [float(x) for x in c], [float(x) for x in w]) for lang, (c, w) in sorted(found.items())]
    known = features.sparkSession.createDataFrame(rows, "__ref string, __chars array<double>, __common array<double>")
    columns = features.columns
    features = features.join(F.broadcast(known), F.col(f"{q}.ref") == F.col("__ref"), "left")
    n = F.col(f"{q}.n_words")
    inside = F.aggregate(F.col(f"{q}.common"), F.lit(0).cast("long"), lambda a, x: a + x)
    common = F.concat(F.col(f"{q}.common"), F.array(n - inside))
    out = features.withColumn("base_failed", base_failed(q))
    out = out.withColumn("char_distance", F.coalesce(distance(F.col(f"{q}.chars"), F.col("__chars")), F.lit(0.0)))
    out = out.withColumn("word_distance", F.coalesce(distance(common, F.col("__common")), F.lit(0.0)))
    limit = lambda most, slack: F.sqrt(F.lit(most * most) + slack * slack / n)
    near = (F.col("char_distance") <= limit(limits.chars, limits.chars_slack)) & (F.col("word_distance") <= limit(limits.words, limits.words_slack))
    out = out.withColumn("kept", ~F.col("base_failed") & ((n < limits.min_words) | near))
    return out.select(*(F.col(f"`{c}`") for c in columns), "base_failed", "char_distance", "word_distance", "kept")


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row a document with its counts, distances and verdict."""
    columns = [c for c in ("doc_id", "text", "lang") if c in docs.columns]
    features = written(with_features(docs.select(*columns)).select("doc_id", "__q"), "quality")
    out = judged(features, references(features), limits)
    return out.select(
        "doc_id", "__q.n_words", "__q.word_chars", "__q.n_symbols", "__q.n_dup_lines", "__q.n_repeat_words",
        "base_failed", "kept", "char_distance", "word_distance",
    )


@carried
def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that are kept. They are written once with their counts, so that no text is shuffled or counted twice."""
    features = written(with_features(docs), "quality-stage")
    return judged(features, references(features), limits).filter("kept").select(*docs.columns)
