"""Operator 2: hierarchical language identification.

A text is first given a language family, then a language of that family. Both
decisions are votes of one-versus-one linear support vector machines over hashed
byte trigrams of the letters, ties going to the larger margin. The machines are
fitted on a bounded sample: at most ``per_lang`` distinct training documents of each
language, those with the least hash of id and text, and ``MOST_ROWS`` in all. Executors
count their trigrams; the driver gets counts, never texts. Every text is read whole,
for fitting and for prediction.

A null text, or one without a letter (of Unicode's category L), is ``und`` with score 0,
as is any text if nothing was learned. Equal votes go to the larger sum of margins, and
equal sums to the first language by name. Rows with a null doc_id count as the empty id.
Repeated rows are predicted alike and learned from once; of texts of one id each counts.
An empty table gives no rows. Columns beyond doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import doc_fold, least_hashed, written
from pagemill.llm.tokens import byte_table, mapped, raw_bytes, slices

FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa ur",
    "sinitic": "yue zh",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
DIM = 4096
PER_LANG = 1000
MOST_ROWS = 12_000
LETTER = regex.compile(r"\p{L}")


def family(lang: str) -> str:
    """A language that no family lists is a family of its own."""
    return FAMILY.get(lang.lower().split("-")[0].split("_")[0], f"={lang}")


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the letters of all texts in a row (DIM: none), and where each text begins."""
    padded = pc.binary_join_element_wise(
        pa.scalar(" ", pa.large_string()), mapped(texts, byte_table(lower=True, letters_only=True)), pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string())
    )
    raw, offsets = raw_bytes(padded)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    a = raw.astype(np.uint32)
    b, c = np.roll(a, -1), np.roll(a, -2)
    code = ((a * np.uint32(2654435761) ^ b * np.uint32(2246822519) ^ c * np.uint32(3266489917)) * np.uint32(668265263)) >> np.uint32(20)
    code = code.astype(np.int64)
    blank = a == 32
    code[(blank & (b == 32)) | ((b == 32) & (c == 32))] = DIM
    code[offsets[1:] - 1] = DIM
    code[offsets[1:] - 2] = DIM
    return code, offsets


def counts(text: str) -> np.ndarray:
    """How often each hashed trigram occurs in a text."""
    code, _ = trigrams(pa.array([text], pa.large_string()))
    return np.bincount(code, minlength=DIM + 1)[:DIM]


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 60, penalty: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM for y in -1, 1, by averaged subgradient steps.

    Shares are weighted by the log ratio of their class means, so that rare and
    common trigrams count alike; the weights returned apply to plain shares.
    """
    up, down = x[y > 0].mean(axis=0) + 1e-5, x[y < 0].mean(axis=0) + 1e-5
    scale = np.abs(np.log(up / down)) / np.sqrt(0.5 * (up + down))
    z = np.hstack([x * scale, np.ones((len(x), 1), dtype=np.float32)]).astype(np.float32)
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-6)
    balance = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    rng = np.random.default_rng(7)
    w, mean = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    step, taken = 0, 0
    for r in range(rounds):
        for part in np.array_split(rng.permutation(len(z)), max(1, len(z) // 64)):
            step += 1
            rate = 1.0 / (penalty * step + 1.0)
            miss = part[(y[part] * (z[part] @ w)) < 1]
            w *= 1 - rate * penalty
            if len(miss):
                w += rate * ((balance[miss] * y[miss]) @ z[miss]) / len(part)
        if r >= rounds // 2:
            mean += w
            taken += 1
    w = mean / taken
    # Row norms differ from text to text, so the bias is kept in the same scale.
    return np.append(w[:-1] * scale, w[-1]).astype(np.float64)


@dataclass
class Model:
    """labels of families and languages; (first, second, weights) of the machines of each level."""

    languages: dict[str, list[str]]
    machines: dict[str | None, list[tuple[str, str, np.ndarray]]]

    def stack(self) -> tuple[list[tuple[str | None, str, str]], np.ndarray, np.ndarray]:
        flat = [(at, a, b, w) for at, group in self.machines.items() for a, b, w in group]
        weights = np.zeros((len(flat), DIM + 1), dtype=np.float32)
        for k, (_, _, _, w) in enumerate(flat):
            weights[k, :DIM] = w[:-1]
        return [x[:3] for x in flat], weights, np.array([x[3][-1] for x in flat])


def fit(rows: list[tuple[np.ndarray, str]]) -> Model:
    """From (trigram counts, lang), in any order."""
    rows = sorted(rows, key=lambda r: (r[1], r[0].tobytes()))
    x = np.array([r / max(1, r.sum()) for r, _ in rows], dtype=np.float32)
    langs = np.array([lang for _, lang in rows])
    homes = np.array([family(lang) for lang in langs])
    languages = {h: sorted(set(langs[homes == h])) for h in sorted(set(homes))}

    def pairs(values: np.ndarray, names: list[str]) -> list[tuple[str, str, np.ndarray]]:
        out = []
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                own = (values == a) | (values == b)
                out.append((a, b, fit_svm(x[own], np.where(values[own] == a, 1, -1))))
        return out

    machines: dict[str | None, list] = {None: pairs(homes, list(languages))}
    for home, names in languages.items():
        machines[home] = pairs(langs, names)
    return Model(languages, machines)


def _decide(names: list[str], machines: list[tuple[int, str, str]], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winner among ``names`` for every row, and its confidence."""
    n = len(margins)
    if len(names) == 1:
        return np.zeros(n, dtype=np.int64), np.ones(n)
    votes, total = np.zeros((n, len(names))), np.zeros((n, len(names)))
    for k, a, b in machines:
        i, j, m = names.index(a), names.index(b), margins[:, k]
        votes[:, i] += m >= 0
        votes[:, j] += m < 0
        total[:, i] += np.tanh(m)
        total[:, j] -= np.tanh(m)
    best = (votes + total / (4 * len(names))).argmax(axis=1)
    return best, 1 / (1 + np.exp(-4 * total[np.arange(n), best] / (len(names) - 1)))


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lettered = np.array([LETTER.search(t) is not None for t in texts.to_pylist()], dtype=bool)
    names, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    if not model.languages or not len(texts):
        return names.tolist(), score
    heads, weights, bias = model.stack()
    code, offsets = trigrams(texts)
    starts = offsets[:-1]
    counted = np.maximum(np.add.reduceat(code < DIM, starts, dtype=np.int64), 1)
    margins = np.zeros((len(texts), len(heads)))
    for k in range(len(heads)):
        margins[:, k] = np.add.reduceat(weights[k][code], starts, dtype=np.float64) / counted
    margins += bias * 1e-3  # decides only where no trigram of the text was seen
    homes = list(model.languages)
    level = lambda at: [(k, a, b) for k, (x, a, b) in enumerate(heads) if x == at]
    first, sure = _decide(homes, level(None), margins)
    for f, home in enumerate(homes):
        own = lettered & (first == f)
        if own.any():
            best, certain = _decide(model.languages[home], level(home), margins[own])
            names[own] = np.array(model.languages[home], dtype=object)[best]
            score[own] = sure[own] * certain
    return names.tolist(), np.clip(score, 0, 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(t) for t in batch["text"].to_pylist()]
        at = [np.flatnonzero(c) for c in found]
        columns = [batch["lang"], pa.array(at, pa.list_(pa.int64())), pa.array([c[i] for c, i in zip(found, at)], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "at", "n"])


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[np.ndarray, str]]:
    """(trigram counts, lang) of at most ``per_lang`` texts of each language and MOST_ROWS in all."""
    known = docs.filter("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("key")
    )
    langs = known.agg(F.count_distinct("lang")).first()[0]
    most = max(1, min(per_lang, MOST_ROWS // max(1, langs)))
    # Keys are chosen before any text moves; MOST_ROWS bounds what is broadcast and what reaches the driver.
    keys = written(least_hashed(known, "lang", "key", most, MOST_ROWS), "langid-sample")
    # A repeated row has the same counts as its twin: one of them is kept.
    rows = known.join(F.broadcast(keys), ["lang", "key"]).select("lang", "text").distinct().mapInArrow(_counted, "lang string, at array<long>, n array<long>")
    out = []
    for r in rows.toLocalIterator():
        row = np.zeros(DIM, dtype=np.int64)
        row[r.at] = r.n
        out.append((row, r.lang))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(size + 1, 8 << 20):
                names, score = predict(shared.value, batch["text"].slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), batch["held_out"].slice(a, b - a), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (doc_fold("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Fit on documents whose crc32(doc_id as text) mod 4 is not 2, predict all."""
    rows = sample(docs.select("doc_id", "text", "lang").filter(doc_fold("doc_id", 4) != 2))
    return identify(docs, fit(rows) if rows else Model({}, {}))
