"""Operator 1: mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The tokens of the cells
are raked: each margin in turn is scaled to its target shares, round after round, until
no scale differs from one by more than ``TOLERANCE``, which gives every cell a weight. A document is sampled with a probability in
proportion to its cell's weight, scaled so that the largest is one: no document is
repeated, and the expected tokens of the sample have the target margins.

Targets are shares given by the caller, or tempered from the corpus: the own share
to a power, at most ``MOST_GAIN`` times the own share, scaled to sum to one.
Whether a document is sampled is decided by a hash of its doc_id and the seed, so
that a rerun, or another cluster, takes the same documents.

Every category has its own share, whatever their number: up to ``CELLS`` cells are
raked on the driver, more by aggregations over the table of cells.

A document's topic is read from the column that ``Mix.column`` names, or else is the
name of the pattern of ``Mix.topics`` with most matches in its whole text: the first of
equals in the order of the patterns, ``PLAIN`` if there are none.

A null or empty text has no tokens and is sampled like its cell. Null source, language or
topic is the category "". A null doc_id counts as the empty id; repeated rows
of an id in one cell are taken or left together. Targets that no document can meet, as of
categories without tokens, are left out and the others scaled to one; targets that
contradict each other are approached for ``ROUNDS`` rounds. An empty table gives no rows.
Columns of clashing names are carried through (``sampled``) or not read (``mixed``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WORD, carried, new_path, removed, stored, written

MARGINS = ("source", "lang", "topic")
MOST_GAIN = 1.25
CELLS = 100_000
ROUNDS, TOLERANCE = 200, 1e-12
#: Of the SQL, which has no convergence test: it goes on further than any of the driver's tables needs.
SQL_ROUNDS = 40
SEED = "mix"

#: Topics by marks in the text, for tables that have no column of topics.
TOPICS = {
    "legal": r"[Ll]icen[cs]e|LICEN[CS]E|[Cc]opyright|[Ww]arranty|[Pp]ermission",
    "contact": r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]",
    "technical": r"[{}<>|#=]",
}
PLAIN = "general"


@dataclass(frozen=True)
class Mix:
    """power: how far each margin is tempered (1: as it is). targets: shares instead, by margin; what they leave out gets nothing.

    column: a column of topics; without one they come from ``topics``, name -> pattern.
    """

    power: dict[str, float] = field(default_factory=lambda: {"source": 0.6, "lang": 0.85, "topic": 0.85})
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    rounds: int = ROUNDS
    seed: str = SEED
    column: str | None = None
    topics: dict[str, str] = field(default_factory=lambda: dict(TOPICS))


def topic(text: Column, topics: dict[str, str]) -> Column:
    hits = [F.regexp_count(text, F.lit(p)) for p in topics.values()]
    best = F.greatest(F.lit(0), F.lit(0), *hits)
    out = F.lit(PLAIN)
    for name, n in reversed([*zip(topics, hits)]):
        out = F.when((n > 0) & (n == best), F.lit(name)).otherwise(out)
    return out


def with_cell(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with the struct __cell: n_tokens, source, lang, topic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    parts = [F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), name("source").alias("source"), name("lang").alias("lang"), (name(mix.column) if mix.column else topic(text, mix.topics)).alias("topic")]
    return docs.withColumn("__cell", F.struct(*parts))


def tempered(own: np.ndarray, power: float, most_gain: float = MOST_GAIN) -> np.ndarray:
    """Target shares from own shares."""
    t = np.where(own > 0, np.power(own, power, where=own > 0, out=np.zeros_like(own)), 0.0)
    t = np.minimum(t / t.sum(), most_gain * own) if t.sum() > 0 else t
    return t / t.sum() if t.sum() > 0 else t


def rake(cells: list[tuple[str, str, str, int]], mix: Mix = Mix()) -> dict[tuple[str, str, str], tuple[float, float]]:
    """(source, lang, topic) -> weight, and probability of being sampled."""
    if not cells:
        return {}
    tokens = np.array([c[3] for c in cells], dtype=np.float64)
    total = tokens.sum()
    codes, targets = [], []
    for i, margin in enumerate(MARGINS):
        names, code = np.unique(np.array([c[i] for c in cells], dtype=object).astype(str), return_inverse=True)
        own = np.bincount(code, tokens, len(names)) / max(total, 1.0)
        if margin in mix.targets:
            want = np.array([mix.targets[margin].get(str(n), 0.0) for n in names])
            want = np.where(own > 0, want, 0.0)
            want = want / want.sum() if want.sum() > 0 else own
        else:
            want = tempered(own, mix.power.get(margin, 1.0))
        codes.append(code)
        targets.append(want)
    weight = np.ones(len(cells))
    for _ in range(mix.rounds):
        apart = 0.0
        for code, want in zip(codes, targets):
            held = np.bincount(code, weight * tokens, len(want))
            scale = np.divide(want * total, held, where=held > 0, out=np.ones_like(held))
            weight, apart = weight * scale[code], max(apart, float(np.abs(scale - 1).max()))
        if apart < TOLERANCE:
            break
    top = weight[tokens > 0].max(initial=0.0)
    p = np.minimum(1.0, weight / top) if top > 0 else np.ones(len(cells))
    return {tuple(c[:3]): (round(float(w), 6), round(float(q), 9)) for c, w, q in zip(cells, weight, p)}


def chance(doc_id: Column, seed: str) -> Column:
    """A number from 0 to 1 for each id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def wanted(cells: DataFrame, margin: str, total: float, mix: Mix) -> DataFrame:
    """The margin's categories with their target share ``want``; as in ``rake``."""
    own = cells.groupBy(margin).agg((F.sum("n") / F.lit(max(total, 1.0))).alias("own"))
    if margin in mix.targets:
        given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in mix.targets[margin].items()], f"{margin} string, t double")
        own = own.join(given, margin, "left").withColumn("t", F.when(F.col("own") > 0, F.coalesce("t", F.lit(0.0))).otherwise(F.lit(0.0)))
    else:
        own = own.withColumn("t", F.when(F.col("own") > 0, F.pow("own", F.lit(mix.power.get(margin, 1.0)))).otherwise(F.lit(0.0)))
        own = written(own, "mix-shares")
        held = own.agg(F.sum("t")).first()[0] or 0.0
        own = own.withColumn("t", F.least(F.col("t") / F.lit(held), MOST_GAIN * F.col("own"))) if held > 0 else own
    own = written(own, "mix-shares")
    held = own.agg(F.sum("t")).first()[0] or 0.0
    return own.select(margin, (F.col("t") / F.lit(held) if held > 0 else F.col("own") if margin in mix.targets else F.col("t")).alias("want"))


def rake_table(cells: DataFrame, mix: Mix) -> DataFrame:
    """``cells`` (source, lang, topic, n) with w and p, as ``rake`` has them, without the driver."""
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    shares = {m: wanted(cells, m, total, mix) for m in MARGINS}
    spark, last = cells.sparkSession, None
    out = cells.withColumn("w", F.lit(1.0))
    for _ in range(mix.rounds):
        apart = 0.0
        for m in MARGINS:
            held = out.groupBy(m).agg(F.sum(F.col("w") * F.col("n")).alias("held")).join(shares[m], m)
            scale = held.select(m, F.when(F.col("held") > 0, F.col("want") * F.lit(total) / F.col("held")).otherwise(F.lit(1.0)).alias("scale"))
            scale = written(scale, "mix-scale")
            apart = max(apart, scale.agg(F.max(F.abs(F.col("scale") - 1))).first()[0] or 0.0)
            path = new_path(spark, "mix-raked")
            out = stored(out.join(scale, m).select(*MARGINS, "n", (F.col("w") * F.col("scale")).alias("w")), path)
            if last:
                removed(spark, last)
            last = path
        if apart < TOLERANCE:
            break
    top = out.filter("n > 0").agg(F.max("w")).first()[0] or 0.0
    return out.withColumn("p", F.least(F.lit(1.0), F.col("w") / F.lit(top)) if top > 0 else F.lit(1.0))


def weights(cells: DataFrame, mix: Mix) -> DataFrame:
    """Of each cell of ``cells`` (n_tokens, source, lang, topic), as a table to join."""
    table = written(cells.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")), "mix-table")
    if table.count() > CELLS:
        return rake_table(table, mix).select(*(F.col(m).alias(f"__{m}") for m in MARGINS), F.round("w", 6).alias("__weight"), F.round("p", 9).alias("__probability"))
    raked = rake([(r.source, r.lang, r.topic, r.n) for r in table.orderBy(*MARGINS).collect()], mix)
    schema = "__source string, __lang string, __topic string, __weight double, __probability double"
    return F.broadcast(cells.sparkSession.createDataFrame([(*k, *v) for k, v in raked.items()], schema))


def joined(docs: DataFrame, found: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` (with __cell) with __weight, __probability, __sampled."""
    at = [F.col(f"__cell.{m}") == F.col(f"__{m}") for m in MARGINS]
    out = docs.join(found, at[0] & at[1] & at[2], "left")
    return out.withColumn("__sampled", chance(F.col("doc_id"), mix.seed) < F.col("__probability"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, n_tokens, source, lang, topic, weight, probability, sampled of every row."""
    columns = [c for c in dict.fromkeys(("doc_id", "text", "source", "lang", mix.column)) if c in docs.columns]
    cells = written(with_cell(docs.select(*columns), mix).select("doc_id", "__cell"), "mix-cells")
    found = weights(cells.select("__cell.*"), mix)
    return joined(cells, found, mix).select(
        F.col("doc_id").cast("long").alias("doc_id"), "__cell.n_tokens", "__cell.source", "__cell.lang", "__cell.topic",
        F.col("__weight").alias("weight"), F.col("__probability").alias("probability"), F.col("__sampled").alias("sampled"),
    )


@carried
def sampled(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` that are sampled. Cells are computed twice, so that no text is shuffled."""
    celled = with_cell(docs, mix)
    # Summed by raw categories first: three scans of the texts become one.
    sums = celled.select("__cell.*").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens"))
    found = weights(sums, mix)
    return joined(celled, found, mix).filter("__sampled").select(*docs.columns)


def _oracle(mix: Mix = Mix()) -> str:
    sql = lambda p: p.replace("'", "''")
    count = lambda p: f"len(regexp_extract_all(coalesce(text, ''), '{sql(p)}'))"
    hits = ", ".join(f"{count(p)} AS k{i}" for i, p in enumerate(TOPICS.values()))
    case = " ".join(f"WHEN k{i} > 0 AND k{i} = greatest({', '.join(f'k{j}' for j in range(len(TOPICS)))}) THEN '{t}'" for i, t in enumerate(TOPICS))
    out = [
        f"d0 AS MATERIALIZED (SELECT doc_id, {count(WORD)} AS n_tokens, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {hits} FROM documents)",
        f"d AS MATERIALIZED (SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, source, lang, CASE {case} ELSE '{PLAIN}' END AS topic FROM d0)",
    ]
    out.append("e AS MATERIALIZED (SELECT *, source AS c_source, lang AS c_lang, topic AS c_topic FROM d)")
    names = ", ".join(f"c_{m}" for m in MARGINS)
    out.append(f"w0 AS MATERIALIZED (SELECT {names}, CAST(sum(n_tokens) AS DOUBLE) AS n, CAST(1 AS DOUBLE) AS g FROM e GROUP BY {names})")
    for m in MARGINS:
        out += [
            f"o_{m} AS (SELECT c_{m}, sum(n) / (SELECT sum(n) FROM w0) AS own FROM w0 GROUP BY c_{m})",
            f"p_{m} AS (SELECT c_{m}, own, CASE WHEN own > 0 THEN power(own, {mix.power[m]}) ELSE 0 END AS t FROM o_{m})",
            f"q_{m} AS (SELECT c_{m}, least(t / (SELECT sum(t) FROM p_{m}), {MOST_GAIN} * own) AS t FROM p_{m})",
            f"t_{m} AS MATERIALIZED (SELECT c_{m}, t / (SELECT sum(t) FROM q_{m}) * (SELECT sum(n) FROM w0) AS want FROM q_{m})",
        ]
    step = 0
    for _ in range(SQL_ROUNDS):
        for m in MARGINS:
            held = f"sum(g * n) OVER (PARTITION BY w{step}.c_{m})"
            cols = ", ".join(f"w{step}.c_{x}" for x in MARGINS)
            out.append(
                f"w{step + 1} AS MATERIALIZED (SELECT {cols}, n, g * CASE WHEN {held} > 0 THEN want / {held} ELSE 1 END AS g "
                f"FROM w{step} JOIN t_{m} ON w{step}.c_{m} = t_{m}.c_{m})"
            )
            step += 1
    out.append(
        f"r AS MATERIALIZED (SELECT {names}, round(g, 6) AS weight, round(least(1.0, g / (SELECT max(g) FROM w{step} WHERE n > 0)), 9) AS probability FROM w{step})"
    )
    on = " AND ".join(f"e.c_{m} = r.c_{m}" for m in MARGINS)
    hash_ = f"CAST('0x' || substr(md5('{mix.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0"
    return (
        f"WITH {', '.join(out)} SELECT doc_id, n_tokens, source, lang, topic, weight, probability, "
        f"CAST({hash_} < probability AS BOOLEAN) AS sampled FROM e JOIN r ON {on}"
    )


ORACLE = _oracle()
