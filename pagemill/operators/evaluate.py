"""Learning tables and evaluation: confusion counts, precision, recall, F, stratified cross-validation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.scalars import TARGETS, percent
from pagemill.operators.judge import PART_ROWS, learn
from pagemill.operators.store import numbered


def feature_table(pages: DataFrame, labels: DataFrame, features: list[str], key: str = "id") -> DataFrame:
    """key, label and features of the labelled pages."""
    return pages.join(labels.select(key, "label"), key).select(key, "label", *features)


def confusion(scored: DataFrame, label: str = "label", decision: str = "decision", *by: str, weight: str | None = None) -> DataFrame:
    """tp, tn, fp, fn; single and multiple are positive. One pass. ``weight``: a column that says how many rows one stands for."""
    yes, said = F.col(label).isin(*TARGETS), F.col(decision).isin(*TARGETS)
    one = F.lit(1) if weight is None else F.col(weight)
    count = lambda c: F.coalesce(F.sum(F.when(c, one).otherwise(0)), F.lit(0)).cast("long")
    return scored.groupBy(*by).agg(count(yes & said).alias("tp"), count(~yes & ~said).alias("tn"), count(~yes & said).alias("fp"), count(yes & ~said).alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    """Adds recall, precision and f; null where a denominator is zero."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    out = counts.withColumns({"recall": share("tp", "fn"), "precision": share("tp", "fp")})
    return out.withColumn("f", F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


def as_percent(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: percent(F.col(c)) for c in columns})


def with_fold(table: DataFrame, label: str, key: str, k: int = 10, into: str = "fold") -> DataFrame:
    """Folds with equal shares of each label: rows of a label are dealt in turn, in the order of (md5 of the key, key).

    Slices of the hash are numbered by themselves, so that no task sees all rows of a label.
    """
    numbered_ = numbered(table.filter(F.col(label).isNotNull()), 0, key, "__nth", label)
    return numbered_.withColumn(into, ((F.col("__nth") - 1) % k).cast("int")).drop("__nth")


def score_table(scored: DataFrame, key: str, features: list[str], label: str = "label") -> DataFrame:
    """key, label, judge, prob and the features of scored rows."""
    return scored.select(key, label, F.col("decision").alias("judge"), F.col("confidence").alias("prob"), *features)


#: name -> (impurity, rows in a leaf, depth): the settings that the report compares.
SETTINGS: dict[str, tuple[str, int, int]] = {
    "entropy_leaf10": ("entropy", 10, 30), "gini_leaf10": ("gini", 10, 30), "entropy_leaf1": ("entropy", 1, 30), "gini_leaf1": ("gini", 1, 30), "entropy_shallow": ("entropy", 10, 5),
}


def cross_validated(table: DataFrame, features: list[str], key: str = "id", k: int = 10, settings: dict[str, tuple[str, int, int]] | None = None) -> DataFrame:
    """theta, fold, tp, tn, fp, fn of each fold under each setting. The loop is over models, not rows; the folds of a setting are fitted at the same time."""
    narrow = table.select(key, "label", *features).persist()  # features are computed once
    counted = with_fold(narrow, "label", key, k).groupBy("fold", "label", *features).agg(F.count("*").alias("__rows")).persist()
    few = counted.coalesce(-(-max(counted.count(), 1) // PART_ROWS)).persist()  # a hundred readers: not the parts of the shuffle each time
    few.count()
    narrow.unpersist()
    counted.unpersist()

    def run(name: str, i: int) -> tuple:
        impurity, leaf, depth = (settings or SETTINGS)[name]
        judge = learn(few.filter(F.col("fold") != i), features, min_leaf=leaf, impurity=impurity, depth=depth, weight="__rows")
        test = few.filter(F.col("fold") == i)
        scored = judge.judged(test) if judge else test.withColumn("decision", F.lit(-1))
        return (name, i, *confusion(scored, weight="__rows").first())

    rows = []
    with ThreadPoolExecutor(k) as pool:
        for name in settings or SETTINGS:
            rows += pool.map(inheritable_thread_target(table.sparkSession)(partial(run, name)), range(k))
    few.unpersist()
    return table.sparkSession.createDataFrame(rows, "theta string, fold int, tp long, tn long, fp long, fn long")


def report(folds: DataFrame) -> DataFrame:
    """Mean rates of each setting over its folds."""
    return rates(folds).groupBy("theta").agg(*(F.avg(c).alias(c) for c in ("recall", "precision", "f")))
