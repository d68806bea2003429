"""Operator 10: quality classifier by ordinal cumulative-link regression.

Grades 0 < 1 < ... share one weight vector over hashed text; P(grade >= k) is
logistic(score - theta_k) with ordered thresholds theta. Features of a whole text:
presence of its hashed words, and the square root of the share of each trigram of
character shapes (letter, capital, digit, kinds of punctuation).

Fitting uses at most ``PER_GRADE`` labelled documents of each grade, those with the
least hash of doc_id; scoring covers every row. A null text is empty: only the
thresholds decide. Without labelled rows, or with those of one grade only, every grade
is null and nothing is kept. If a document has several labels, its least grade counts;
labels without doc_id or grade teach nothing. Repeated rows are scored alike; of an id
with several texts the least text is learned from. Very long texts are taken whole, in
slices of rows. Tables without rows give none. Further columns are not read, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import doc_fold, least_hashed, written
from pagemill.llm.tokens import mapped, raw_bytes, slices, words

WORD_BITS = 18
WORDS = 1 << WORD_BITS
KINDS = 16
SHAPES = KINDS**3
PER_GRADE = 3000
MIN_DOCS = 3


def _kinds() -> np.ndarray:
    out = np.full(256, 14, dtype=np.int64)
    out[97:123] = out[128:] = 0
    out[65:91], out[48:58] = 1, 2
    out[[32, 9, 11, 12, 13]], out[10] = 3, 4
    for kind, chars in enumerate((b".,;:", b"!", b"?", b"|", b"#*$%&", b"\"'()[]{}", b"@", b"-/_", b"<>"), 5):
        out[list(chars)] = kind
    return out


def _word_table() -> np.ndarray:
    out = np.full(256, 32, dtype=np.uint8)
    out[97:123], out[48:58], out[128:] = np.arange(97, 123), np.arange(48, 58), np.arange(128, 256)
    out[65:91] = np.arange(97, 123)
    return out


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each distinct hashed word of each text."""
    codes, distinct, starts = words(texts, _word_table())
    bucket = np.fromiter((zlib.crc32(w.encode()) & (WORDS - 1) for w in distinct.to_pylist()), np.int64, len(distinct))
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(starts))
    key = np.unique((owner << WORD_BITS) | bucket[codes]) if len(codes) else np.zeros(0, np.int64)
    return key >> WORD_BITS, key & (WORDS - 1)


def shape_features(texts: pa.Array) -> np.ndarray:
    """Square roots of the shares of the shape trigrams, a row for each text."""
    raw, offsets = raw_bytes(mapped(texts, np.arange(256, dtype=np.uint8)))
    out = np.zeros((len(texts), SHAPES))
    if len(raw) < 3:
        return out
    kind = _kinds()[raw]
    code = kind[:-2] * (KINDS * KINDS) + kind[1:-1] * KINDS + kind[2:]
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    own = owner[:-2] == owner[2:]
    out = np.bincount(owner[:-2][own] * SHAPES + code[own], minlength=len(texts) * SHAPES).reshape(-1, SHAPES)
    return np.sqrt(out / np.maximum(1, out.sum(axis=1, keepdims=True)))


@dataclass
class Model:
    word: np.ndarray
    shape: np.ndarray
    theta: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], rounds: int = 250, l1: float = 2e-4, l2: float = 1e-5) -> Model:
    """From (buckets, shape numbers, shape values, grade): proximal AdaGrad on the mean negative log likelihood."""
    grades = np.array([r[3] for r in rows])
    top = int(grades.max())
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    bucket = np.concatenate([r[0] for r in rows]).astype(np.int64)
    often = np.bincount(bucket, minlength=WORDS) >= MIN_DOCS
    own = often[bucket]
    owner, bucket = owner[own], bucket[own]
    shape = np.zeros((len(rows), SHAPES))
    for i, r in enumerate(rows):
        shape[i, r[1]] = r[2]
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    word, form = np.zeros(WORDS), np.zeros(SHAPES)
    seen = [np.full(WORDS, 1e-8), np.full(SHAPES, 1e-8), np.full(top, 1e-8)]
    # Every grade weighs the same, so that a rare one is learned too.
    weight = (1 / np.bincount(grades, minlength=top + 1).clip(1))[grades]
    weight = weight / weight.sum()
    for _ in range(rounds):
        score = np.bincount(owner, word[bucket], minlength=len(rows)) + shape @ form
        cuts = np.concatenate(([-np.inf], theta, [np.inf]))
        low, high = _sigmoid(score - cuts[grades]), _sigmoid(score - cuts[grades + 1])
        p = np.maximum(low - high, 1e-9)
        dl, dh = low * (1 - low) / p, high * (1 - high) / p
        pull = -(dl - dh) * weight
        by_theta = np.zeros(top + 2)
        np.add.at(by_theta, grades, dl * weight)
        np.add.at(by_theta, grades + 1, -dh * weight)
        steps = (np.bincount(bucket, pull[owner], minlength=WORDS) + l2 * word, pull @ shape + l2 * form, by_theta[1:-1])
        for k, (value, g, rate) in enumerate(zip((word, form, theta), steps, (0.3, 0.5, 0.2))):
            seen[k] += g * g
            size = rate / np.sqrt(seen[k])
            value -= size * g
            if k == 0:  # words that do not pay for themselves go to zero
                np.copyto(value, np.sign(value) * np.maximum(np.abs(value) - size * l1, 0))
        theta.sort()
    return Model(word, form, theta)


def _shape_lists(texts: pa.Array) -> tuple[list, list]:
    dense = shape_features(texts)
    at = [np.flatnonzero(row) for row in dense]
    return at, [row[i] for row, i in zip(dense, at)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one in range(0, batch.num_rows, 256):
            texts = pc.fill_null(batch["text"].slice(one, 256), "")
            row, bucket = word_features(texts)
            cut = np.searchsorted(row, np.arange(1, len(texts)))
            at, value = _shape_lists(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(np.split(bucket, cut)), pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float64())), batch["grade"].slice(one, 256)],
                ["bucket", "shape", "value", "grade"],
            )


def labelled(docs: DataFrame, labels: DataFrame, grade: Column, per_grade: int = PER_GRADE) -> list:
    """Features and grade of the sample. Ids are chosen before any text moves."""
    graded = labels.select("doc_id", grade.cast("int").alias("grade")).filter("grade is not null and doc_id is not null")
    graded = graded.groupBy("doc_id").agg(F.min("grade").alias("grade")).join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = written(least_hashed(graded, "grade", "doc_id", per_grade), "ordinal-sample")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text for each id, so that an id that repeats without end sends one row.
    rows = rows.groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("text", "grade")
    made = rows.mapInArrow(_features, "bucket array<long>, shape array<long>, value array<double>, grade int")
    out = [(np.array(r.bucket), np.array(r.shape, dtype=np.int64), np.array(r.value), r.grade) for r in made.toLocalIterator()]
    return sorted(out, key=lambda r: (r[3], len(r[0]), r[0].tolist()[:8]))


def score(docs: DataFrame, model: Model | None, folds: int = 5, out_fold: int = 2, least: float = 0.2) -> DataFrame:
    """doc_id, held_out, grade (expected), tail (probability of the best grade), kept.

    Grades weigh the same in fitting, where good documents are the most by far: hence ``least`` below a half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = pc.fill_null(batch["text"].cast(pa.large_string()), "")
            size = pc.binary_length(texts).to_numpy().astype(np.int64)
            for a, b in slices(size + 1000, 4 << 20):
                some = texts.slice(a, b - a)
                if m is None:
                    grade = tail = pa.nulls(b - a, pa.float64())
                    kept = np.zeros(b - a, dtype=bool)
                else:
                    row, bucket = word_features(some)
                    s = np.bincount(row, m.word[bucket], minlength=b - a) + shape_features(some) @ m.shape
                    above = _sigmoid(s[:, None] - m.theta[None, :])
                    grade, tail = pa.array(above.sum(axis=1)), pa.array(above[:, -1])
                    kept = above[:, -1] >= least
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["held_out"].slice(a, b - a), grade, tail, pa.array(kept)],
                    ["doc_id", "held_out", "grade", "tail", "kept"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (doc_fold("doc_id", folds) == out_fold).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, grade double, tail double, kept boolean")


def quality_grade() -> Column:
    """0 toxic, 1 poor, 2 good; null if neither label is given."""
    toxic, quality = F.col("toxic"), F.col("quality")
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def classify(docs: DataFrame, labels: DataFrame, grade: Column | None = None) -> DataFrame:
    """Fit on labelled documents outside the held-out fold, score every document."""
    known = labels.filter(doc_fold("doc_id", 5) != 2)
    rows = labelled(docs, known, quality_grade() if grade is None else grade)
    model = fit(rows) if len({r[3] for r in rows}) > 1 else None
    return score(docs, model)
